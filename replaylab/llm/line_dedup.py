"""Line dedup with sharded cuckoo filters over exact reference counts, incremental and reversible (operator 8).

State.
* ``references``: the exact table.  One row per document and distinct long line key, with a sign: +1 when the
  document is inserted, -1 when it is deleted.  A key's reference count is the number of live documents that hold
  it.
* ``filters``: one cuckoo filter per shard of the key space, over the keys held by ``min_docs`` documents or more.
``LineStore`` keeps both, and each batch's signed counts, between batches: a commit folds its batch in and inserts into or deletes
from the filters of just those shards in which a key reached or left ``min_docs``.

Dropping.  The lines' keys stream past their shard's filter, which lets the keys pass that may be repeated; only
these meet the exact counts, which decide.  A filter's false positives therefore change nothing, and it has no
false negatives.  A shard's lines are spread over ``salts`` tasks, each with a copy of the filter, and counts are
summed map-side, so one line held by a third of all documents lands in no single task.

Defined results.  A null or empty text is one empty line.  Each row counts as a document, also when its
``doc_id`` repeats; rows that share the largest ``doc_id`` all keep the line.  Rows with a null ``doc_id``
count too, but hold a line only if no other row does.  Other columns pass through untouched, whatever their
names.  An empty table gives none.  A text of any length is handled row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from replaylab.llm._common import slices, stored, unused, utf8_rows
from replaylab.llm.cuckoo import CuckooFilter
from replaylab.sources import published

MIN_CHARS = 20
MIN_DOCS = 3
#: Keys in one shard's filter, about.
SHARD_KEYS = 50_000
#: Tasks over which the lines of one shard are spread.
SALTS = 32


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """16-byte digest of a line's key, or None for a key of fewer than ``min_chars`` code points."""
    from hashlib import blake2b

    key = line.strip().lower()  # on bytes: the six ASCII blanks, A-Z only
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return blake2b(key, digest_size=16).digest()


def references(df: DataFrame, sign: int = 1, min_chars: int = MIN_CHARS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(``key``, whole long, line binary, sign int): each row's distinct long line keys; ``whole`` is the text's hash.

    Rows of equal id and text hold the same lines, so the two together stand for a row, with or without an id.
    """
    schema = T.StructType([df.schema[key]]).add("whole", "long").add("line", "binary").add("sign", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows, lines = [], []
            for i, whole in enumerate(utf8_rows(batch.column(text))):
                found = {line_key(x, min_chars) for x in whole.split(b"\n")} - {None}
                rows.extend([i] * len(found))
                lines.extend(found)
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(rows), batch.column("line_whole").take(rows), pa.array(lines, pa.binary()),
                                              pa.array(np.full(len(rows), sign, dtype=np.int32))], names=schema.names)

    return df.select(key, text, F.xxhash64(text).alias("line_whole")).mapInArrow(run, schema)


def counts(refs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(line, n_docs, keeper): exact reference counts of live documents, summed map-side."""
    return refs.groupBy("line").agg(F.sum("sign").alias("n_docs"), F.max(key).alias("keeper")).where("n_docs > 0")


def live(refs: DataFrame, key: str = "doc_id") -> DataFrame:
    """References with the deleted documents' cancelled out."""
    return refs.groupBy(key, "whole", "line").agg(F.sum("sign").cast("int").alias("sign")).where("sign > 0")


def shards_for(n_keys: int) -> int:
    return max(1, -(-n_keys // SHARD_KEYS))


def _shard(n_shards: int):
    return F.pmod(F.xxhash64("line"), F.lit(n_shards)).cast("int")


def _hashes(lines: pa.Array) -> np.ndarray:
    """The first eight bytes of each 16-byte digest."""
    whole = np.frombuffer(b"".join(lines.to_pylist()), dtype=np.uint64)
    return whole.reshape(-1, 2)[:, 0]


def build_filters(repeated: DataFrame, n_shards: int) -> DataFrame:
    """(shard, filter): a cuckoo filter per shard over the lines of ``repeated`` (distinct keys)."""

    def one(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "filter": pa.array([], pa.binary())})
        made = CuckooFilter.of(_hashes(table["line"].combine_chunks()))
        return pa.table({"shard": table["shard"].slice(0, 1), "filter": pa.array([made.to_bytes()], pa.binary())})

    return repeated.select(_shard(n_shards).alias("shard"), "line").groupBy("shard").applyInArrow(one, "shard int, filter binary")


def update_filters(filters: DataFrame, changes: DataFrame, repeated: DataFrame, n_shards: int) -> DataFrame:
    """Filters after (line, sign) changes: keys that reached (+1) or left (-1) the count.

    Only shards with changes are touched.  A shard that has no place left is built anew, larger, from the exact
    ``repeated`` keys of that shard.
    """
    moved = changes.select(_shard(n_shards).alias("shard"), "line", F.col("sign").cast("int").alias("sign"))
    touched = moved.select("shard").distinct()
    exact = repeated.select(_shard(n_shards).alias("shard"), "line").join(touched, "shard", "left_semi")
    rows = (filters.join(touched, "shard", "left_semi").select("shard", F.lit(0).alias("kind"), F.col("filter").alias("cell"))
            .unionByName(moved.select("shard", "sign", "line").select("shard", F.col("sign").alias("kind"), F.col("line").alias("cell")))
            .unionByName(exact.select("shard", F.lit(2).alias("kind"), F.col("line").alias("cell"))))

    def one(table: pa.Table) -> pa.Table:
        kind, cells = table["kind"].to_numpy(), table["cell"].combine_chunks()
        of = lambda k: cells.filter(pa.array(kind == k))
        held = of(0).to_pylist()
        made = CuckooFilter.from_bytes(held[0]) if held else None
        fits = made is not None
        if fits:
            for h in _hashes(of(-1)).tolist():
                made.delete(h)
            fits = all([made.insert(h) for h in _hashes(of(1)).tolist()])
        if not fits:
            made = CuckooFilter.of(_hashes(of(2)))
        return pa.table({"shard": table["shard"].slice(0, 1), "filter": pa.array([made.to_bytes()], pa.binary())})

    changed = rows.groupBy("shard").applyInArrow(one, "shard int, filter binary")
    return filters.join(touched, "shard", "left_anti").unionByName(changed)


def maybe_repeated(refs: DataFrame, filters: DataFrame, n_shards: int, salts: int = SALTS, key: str = "doc_id") -> DataFrame:
    """(``key``, whole, line) rows whose line passes its shard's filter.

    Filters and lines of a shard meet in one sorted stream, the filter first; a task holds one filter and one
    batch of lines at a time.
    """
    id_type = refs.schema[key].dataType
    lines = refs.select(_shard(n_shards).alias("shard"), F.pmod(F.xxhash64(key, "whole", F.lit(1)), F.lit(salts)).cast("int").alias("salt"),
                        F.lit(1).alias("kind"), F.col("line").alias("cell"), key, "whole")
    copies = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
                            F.lit(0).alias("kind"), F.col("filter").alias("cell"), F.lit(None).cast(id_type).alias(key), F.lit(None).cast("long").alias("whole"))
    schema = T.StructType([refs.schema[key]]).add("whole", "long").add("line", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if start == end:
                    continue
                cells = batch.column("cell").slice(start, end - start)
                if kinds[start] == 0:
                    shard, held = shards[start], CuckooFilter.from_bytes(cells[0].as_py())
                elif shard == shards[start]:  # a shard without a filter has no repeated line
                    passed = pa.array(held.contains(_hashes(cells)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, end - start).filter(passed) for c in (key, "whole")),
                                                      cells.filter(passed)], names=schema.names)

    return (lines.unionByName(copies).repartition("shard", "salt").sortWithinPartitions("shard", "kind")
            .mapInArrow(run, schema))


def dropped(refs: DataFrame, min_docs: int = MIN_DOCS, key: str = "doc_id") -> DataFrame:
    """(``key``, whole, lines array<binary>): per document the line keys that it loses."""
    repeated = stored(counts(refs, key).where(F.col("n_docs") >= min_docs), "line-counts")
    n_shards = shards_for(repeated.count())
    filters = stored(build_filters(repeated, n_shards), "line-filters")
    return _verified(maybe_repeated(refs, filters, n_shards, key=key), repeated, key)


def _verified(passed: DataFrame, repeated: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, whole, lines): what each document loses, of the lines that passed a filter, by the exact ``repeated`` lines."""
    verified = passed.join(repeated.select("line", "keeper"), "line")
    lost = verified.where(~F.col(key).eqNullSafe(F.col("keeper")))
    return lost.groupBy(key, "whole").agg(F.collect_set("line").alias("lines"))  # at most the document's own lines


def rewrite(df: DataFrame, lost: DataFrame, min_chars: int = MIN_CHARS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with the lost lines cut from the text; null texts become empty.

    Adds a struct (n_lines, n_dropped) named ``line_dedup``, with underscores behind it if ``df`` has that name already.
    """
    others = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text))
    rows = df.select(others.alias("row"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("whole"))
    lost = lost.select(F.col(key).alias("lost_id"), F.col("whole").alias("lost_whole"), "lines")
    joined = rows.join(lost, rows.row[key].eqNullSafe(lost.lost_id) & (rows.whole == lost.lost_whole), "left").select("row", "text", "lines")
    schema = T.StructType([joined.schema["row"]]).add("text", "string").add("n_lines", "long").add("n_dropped", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, totals, cut = [], [], []
            for whole, gone in zip(utf8_rows(batch.column("text")), batch.column("lines").to_pylist()):
                lines = whole.split(b"\n")
                kept = lines
                if gone:
                    gone = set(gone)
                    kept = [x for x in lines if line_key(x, min_chars) not in gone]
                    whole = b"\n".join(kept)
                texts.append(whole)
                totals.append(len(lines))
                cut.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()),
                                              pa.array(cut, pa.int64())], names=schema.names)

    cleaned = joined.mapInArrow(run, schema)
    return cleaned.select(*((F.col("text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in df.columns),
                          F.struct("n_lines", "n_dropped").alias(unused(df, "line_dedup")))


def dedup(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` without its repeated lines, and struct ``line_dedup`` (see :func:`rewrite`); one insertion into an empty state."""
    refs = stored(references(df, 1, min_chars, text, key), "line-references")
    return rewrite(df, dropped(refs, min_docs, key), min_chars, text, key)


_REFERENCES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("whole", T.LongType()), T.StructField("line", T.BinaryType()),
                            T.StructField("sign", T.IntegerType())])
_COUNTS = T.StructType([T.StructField("line", T.BinaryType()), T.StructField("n_docs", T.LongType())])
_FILTERS = T.StructType([T.StructField("filter", T.BinaryType())])
_BY_SHARD = T.StructType([T.StructField("shard", T.IntegerType())])


class LineStore:
    """The incremental state in a shared folder: insert and delete batches of documents, in any order, each batch id once.

    ``references`` holds each batch's signed references, ``counts`` each batch's signed counts by line (exact reference counts are
    their sums), ``filters`` the shards' filters over the repeated lines.  A commit folds its batch into all three and
    touches the filters of only those shards in which a line reached ``min_docs`` or fell below it.  All are published by
    marker, the batch's mark last: a commit that dies on the way is not seen, and committing its id again completes it.
    """

    def __init__(self, spark: SparkSession, path: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_shards: int = 16):
        self.spark, self.path, self.min_chars, self.min_docs, self.n_shards = spark, path.rstrip("/"), min_chars, min_docs, n_shards

    def _read(self, name: str, schema: T.StructType, by: T.StructType = T.StructType(), column: str = "batch") -> DataFrame:
        found = published.read(self.spark, f"{self.path}/{name}", schema, by, column)
        return found if found is not None else self.spark.createDataFrame([], T.StructType([*schema, T.StructField(column, T.StringType()), *by]))

    def batches(self) -> set[str]:
        """Ids of the batches committed so far."""
        found = published.marks(self.spark, f"{self.path}/counts")
        return set() if found is None else {r.unit for r in found.select("unit").distinct().collect()}

    def commit(self, batch_id: str, docs: DataFrame, sign: int) -> bool:
        """Insert (+1) or delete (-1) whole documents; False, and no change, for a batch id that was committed before."""
        if sign not in (1, -1):
            raise ValueError("sign must be 1 or -1")
        if batch_id in self.batches():
            return False
        refs = stored(references(docs, sign, self.min_chars), "line-batch")
        delta = stored(refs.groupBy("line").agg(F.sum("sign").alias("n_docs")), "line-delta")
        self._update_filters(delta)
        published.publish(refs, f"{self.path}/references", batch_id, column="batch")
        published.publish(delta, f"{self.path}/counts", batch_id, column="batch")  # last: now the batch counts
        return True

    def _update_filters(self, delta: DataFrame) -> None:
        """Publish anew the filters of the shards in which a line of the batch crossed ``min_docs``."""
        before = self.line_counts().select(F.col("line").alias("l"), F.col("n_docs").alias("old"))
        both = delta.join(before, delta.line == before.l, "left").select("line", F.coalesce("old", F.lit(0)).alias("old"), F.col("n_docs").alias("more"))
        was, now = F.col("old") >= self.min_docs, F.col("old") + F.col("more") >= self.min_docs
        moved = stored(both.where(was != now).select("line", F.when(now, 1).otherwise(-1).alias("sign")), "line-moved")
        shards = [r.shard for r in moved.select(_shard(self.n_shards).alias("shard")).distinct().collect()]  # at most n_shards numbers
        if not shards:
            return
        # The exact lines of the touched shards after this batch, should a filter have to grow.
        whole = self.line_counts().unionByName(delta).where(_shard(self.n_shards).isin(shards)).groupBy("line").agg(F.sum("n_docs").alias("n_docs"))
        exact = whole.where(F.col("n_docs") >= self.min_docs).select("line")
        held = self.filters().where(F.col("shard").isin(shards))
        made = stored(update_filters(held, moved, exact, self.n_shards), "line-filters")
        for shard in shards:
            published.publish(made.where(F.col("shard") == shard).select("shard", "filter"), f"{self.path}/filters", f"shard-{shard}", ("shard",))

    def line_counts(self) -> DataFrame:
        """(line, n_docs): exact reference counts, summed over the committed batches' signed counts."""
        return self._read("counts", _COUNTS).groupBy("line").agg(F.sum("n_docs").alias("n_docs")).where("n_docs != 0")

    def filters(self) -> DataFrame:
        """(shard, filter): the stored filters; a shard without repeated lines may have none."""
        return self._read("filters", _FILTERS, _BY_SHARD, "unit").select("shard", "filter")

    def references(self) -> DataFrame:
        """Live references of all committed batches."""
        done = self.batches()
        return live(self._read("references", _REFERENCES).where(F.col("batch").isin(list(done))).select("doc_id", "whole", "line", "sign"))

    def repeated(self) -> DataFrame:
        """(line, n_docs, keeper): the lines that ``min_docs`` live documents or more hold."""
        often = self.line_counts().where(F.col("n_docs") >= self.min_docs).select("line")
        return counts(self.references().join(often, "line", "left_semi"))

    def compact(self) -> None:
        """Rewrite the batches' references and counts into few files."""
        published.compact(self.spark, f"{self.path}/references", _REFERENCES, column="batch")
        published.compact(self.spark, f"{self.path}/counts", _COUNTS, column="batch")

    def clean(self, docs: DataFrame) -> DataFrame:
        """Live documents without the lines that the state says are repeated: past the stored filters, then the exact counts."""
        passed = maybe_repeated(references(docs, 1, self.min_chars), self.filters(), self.n_shards)
        return rewrite(docs, _verified(passed, stored(self.repeated(), "line-counts")), self.min_chars)
