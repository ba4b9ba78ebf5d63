"""SimHash near-duplicates, found with pivot distance tables (operator 5).

Method.
1. One 64-bit fingerprint per document; equal ones form one class, so copies never meet as pairs.
2. The *pivot table* has, for each distinct fingerprint, its Hamming distances to ``PIVOTS`` fixed
   reference fingerprints.  By the triangle inequality two fingerprints within ``d`` bits differ by at most
   ``d`` in every coordinate.
3. Candidates meet where they agree on half of their bits: two fingerprints that differ in at most two
   bits agree on two of four 16-bit blocks at least (six block pairs, six rows per fingerprint).  In a
   bucket, pairs whose largest coordinate difference is over ``d`` are discarded, the rest verified bit by
   bit, and the bucket's links leave as stars, one row per linked member.
4. A bucket of over ``BUCKET`` members is not compared but dealt out again in the same way on the bits it
   doesn't share yet, twice at most: after that, members share 56 bits, so a bucket has 256 at most.
   Nothing is dropped; bucket sizes are counted before any row is dealt to a bucket.
5. Links become components, and components go back to the documents by fingerprint.

Defined results: a null or empty text (no word) has fingerprint zero and links like any other.  Repeated
rows give one row each.  A null ``doc_id`` keeps its row and is never the id of a component unless the
whole component has none; such rows are kept or dropped like any other.  Other columns are not read, whatever their names.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from replaylab.llm._common import slices, stored, unused, utf8_rows
from replaylab.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
BUCKET = 256
N_PIVOTS = 24
#: Reference fingerprints: fixed random words.
PIVOTS = np.random.default_rng(20240501).integers(0, 1 << 64, N_PIVOTS, dtype=np.uint64)
_TWO_OF_FOUR = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def _split(bits: list[int]) -> list[list[int]]:
    """The six halves of a bit list: two of its four blocks."""
    n = len(bits) // 4
    blocks = [bits[i * n:(i + 1) * n] for i in range(4)]
    return [blocks[i] + blocks[j] for i, j in _TWO_OF_FOUR]


def _refine(shared: list[int]) -> list[list[int]]:
    rest = [b for b in range(64) if b not in shared]
    return [shared + more for more in _split(rest)]


def _signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


#: By level, the masks of shared bits: 6 of 32 bits, 36 of 48 bits, 216 of 56 bits.  Each mask has six followers.
_LEVELS: list[list[list[int]]] = [_split(list(range(64)))]
for _ in range(2):
    _LEVELS.append([m for shared in _LEVELS[-1] for m in _refine(shared)])


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    digest, join = xxhash.xxh64_digest, b" ".join
    ones, step = np.zeros(64, dtype=np.int64), 1 << 16
    for at in range(0, n, step):
        hashes = b"".join([digest(join(words[i:i + shingle_words]), 42) for i in range(at, min(n, at + step))])
        ones += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(``key``, fp): one row per row of ``df``; fp is the fingerprint's bits as a signed long."""
    schema = T.StructType([df.schema[key]]).add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            fps = np.array([fingerprint(t, shingle_words) for t in utf8_rows(batch.column(text))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(fps.view(np.int64))], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def pivot_table(distinct: DataFrame) -> DataFrame:
    """(fp, near): each fingerprint's Hamming distances to the reference fingerprints, as bytes."""
    signed = PIVOTS.view(np.int64).tolist()
    return distinct.select("fp", F.array(*(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("tinyint") for p in signed)).alias("near"))


def _dealt(pivots: DataFrame, level: int) -> DataFrame:
    """Rows (mask, bits, fp, near): each fingerprint under its masks of a level; ``mask`` numbers them."""
    if level == 0:
        masks = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
                          for i, m in enumerate(_LEVELS[0])))
        return pivots.select("fp", "near", F.inline(masks))
    table = F.array(*(F.lit(_signed(m)) for m in _LEVELS[level]))
    followers = F.transform(F.sequence(F.col("mask") * 6, F.col("mask") * 6 + 5), lambda i: F.struct(
        i.alias("mask"), F.col("fp").bitwiseAND(F.get(table, i)).alias("bits")))
    return pivots.select("fp", "near", F.inline(followers))


def _pairs(fp: np.ndarray, near: np.ndarray, group: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of rows with equal ``group`` (sorted); the pivot table discards most."""
    left, right, apart = [], [], 1
    while apart < len(fp):
        i = np.flatnonzero(group[:-apart] == group[apart:])
        if not len(i):
            break
        i = i[np.abs(near[i] - near[i + apart]).max(axis=1) <= max_bits]
        i = i[np.bitwise_count(fp[i] ^ fp[i + apart]) <= max_bits]
        left.append(i)
        right.append(i + apart)
        apart += 1
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest linked row of each row."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, left, root[right])
        np.minimum.at(root, right, root[left])
        root = root[root]
        if np.array_equal(root, before):
            return root


def _bucket_links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def links(parts: list[np.ndarray]) -> pa.RecordBatch:
            mask, bits, fp, near = parts
            group = np.cumsum(np.concatenate([[True], (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])]))
            root = _roots(len(fp), *_pairs(fp.view(np.uint64), near, group, max_bits))
            i = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[root[i]])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("near").flatten()
            parts = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "bits", "fp")]
            parts.append(flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int16))
            if held is not None:
                parts = [np.concatenate(p) for p in zip(held, parts)]
            mask, bits = parts[:2]
            last = int(np.flatnonzero((mask != mask[-1]) | (bits != bits[-1]))[-1]) + 1 if (
                mask[0] != mask[-1] or bits[0] != bits[-1]) else 0
            if last:
                yield links([p[:last] for p in parts])
            held = [p[last:] for p in parts]  # the last bucket may go on
        if held is not None:
            yield links(held)

    return run


def links(classes: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(u, v) stars that join all distinct fingerprints of ``classes`` within ``max_bits`` of each other, transitively.

    ``max_bits`` is two at most: that is what two of four shared blocks stand for.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    found = None
    pivots = pivot_table(classes)
    for level in range(len(_LEVELS)):
        dealt = _dealt(pivots, level)
        # Sizes first: counted map-side, so a crowded bucket costs no task more than others.
        size = dealt.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1")
        met = stored(dealt.join(size, ["mask", "bits"]), "simhash-buckets")
        last = level == len(_LEVELS) - 1
        small = (met if last else met.where(F.col("n") <= bucket)).select("mask", "bits", "fp", "near")
        stars = small.repartition("mask", "bits").sortWithinPartitions("mask", "bits").mapInArrow(
            _bucket_links(max_bits), "u long, v long")
        found = stars if found is None else found.unionByName(stars)
        pivots = met.where(F.col("n") > bucket).select("fp", "near", "mask")
        if last or pivots.isEmpty():
            return found.distinct()


def _by_component(docs: DataFrame, least: Column, max_bits: int) -> DataFrame:
    """(fp, least): per distinct fingerprint of stored ``docs`` the smallest ``least`` of its whole component. Stored."""
    classes = stored(docs.groupBy("fp").agg(F.min(least).alias("least")), "simhash-classes")
    linked = components(links(classes.select("fp"), max_bits), "simhash-links")
    named = linked.join(classes, linked.node == classes.fp).select("node", "root", "least")
    smallest = named.groupBy("root").agg(F.min("least").alias("smallest"))
    joined = named.join(smallest, "root").select(F.col("node").alias("fp"), "smallest")
    # Stored, so that a join with it stands alone and Spark can split a fingerprint that a third of all rows share.
    return stored(classes.join(joined, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("least")), "simhash-whole")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", shingle_words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(``key``, fingerprint, component_id) for every row: the smallest ``key`` reachable over links."""
    docs = stored(fingerprints(df, text, key, shingle_words), "simhash")
    whole = _by_component(docs, F.col(key), max_bits)
    return docs.join(whole, "fp", "left").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def kept_documents(df: DataFrame, text: str = "text", key: str = "doc_id", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``df`` without the near copies: of each component just one row stays, that with the smallest ``key`` (nulls last).

    Rows are numbered first, so ids that repeat or are missing neither lose a component's only row nor keep two of it.
    """
    fp, row = (unused(df, name) for name in ("simhash_fp", "simhash_row"))
    schema = T.StructType([*df.schema.fields, T.StructField(fp, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            fps = np.array([fingerprint(t, shingle_words) for t in utf8_rows(batch.column(text))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=schema.names)

    rows = stored(df.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    docs = rows.select(F.col(fp).alias("fp"), F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(row).alias("row")).alias("who"))
    keepers = _by_component(docs, F.col("who"), max_bits).select(F.col("least.row").alias(row)).distinct()
    return rows.join(keepers, row, "left_semi").select(df.columns)
