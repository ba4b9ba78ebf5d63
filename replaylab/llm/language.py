"""Language identification by hierarchical discrimination (operator 12).

Method.
1. A text is reduced to its lower-cased letters, single spaces between words, and counted as byte runs of one to ``LONGEST_RUN``
   bytes hashed to ``DIMS`` buckets.
2. First the *family*: multinomial naive Bayes over the bucket counts, with one class per language family.
3. Then, within the predicted family only, *one-versus-one linear support vector machines*: one machine per pair of the family's
   languages, each a weight per bucket; the language that wins most pairs is predicted, ties go to the larger sum of margins,
   then to the smaller code.

Training.  Rows with a non-null language whose ``crc32(id) % FOLDS`` is not ``HELD_OUT``.  A bounded sample is learned from:
``SAMPLE_ROWS`` rows of each language at most, those with the smallest hash of their id and text (whole texts).  Family totals
are summed by Spark; each pair's machine is fitted in a task of its own, on at most two languages' samples.  What reaches the
driver is a weight per bucket for each family and pair.

Families are the fixed table below; languages that it lacks form one family of their own, so any code can be learned.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing was learned.  A
family of one language needs no machine.  Null ids are read as empty texts (never held out) and rows that repeat get one row each.
Only the id, text and language columns are read, whatever the others' names.  An empty table gives none.  A very long text is
counted block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from replaylab.llm._common import slices, stored, utf8_rows

DIMS = 1 << 13
LONGEST_RUN = 4
#: Bytes of a text counted at once.
BLOCK_BYTES = 1 << 19
#: Rows of each language that the model is fitted on, at most.
SAMPLE_ROWS = 600
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
OTHER_FAMILY = "other"
#: Passes over a pair's sample, and the cost of a row on the wrong side.
EPOCHS, COST = 20, 1.0
#: Bytes that the family's evidence counts for at most, so that it stays a probability on long texts.
EVIDENCE = 200

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "celtic": "br cy ga gd",
    "austronesian": "id jv mg ms su tl",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
    "hellenic": "el",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

# Letters stay, A-Z lower-cased; other ASCII becomes a space; bytes of other characters stay.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Odd multipliers that mix a run's bytes, by its length.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


class Model(NamedTuple):
    """Families with their languages; naive Bayes weights; machines by (family, language, language)."""

    families: list[tuple[str, list[str]]]
    bayes: np.ndarray  # (families, DIMS + 1): log probabilities, the last is the prior's
    machines: dict[tuple[str, str], np.ndarray]  # DIMS + 1 weights, the last is the bias; positive means the first language


def family_of(lang: str) -> str:
    """The family of a language code; a region or script after ``-`` or ``_`` doesn't count."""
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], OTHER_FAMILY)


def letters(text: bytes) -> bytes:
    """Words of letters with single spaces between them and at both ends."""
    return b" " + b" ".join(text.translate(_LETTERS).split()) + b" "


def run_counts(text: bytes) -> np.ndarray:
    """How many byte runs of the whole text fall into each bucket."""
    out = np.zeros(DIMS, dtype=np.int64)
    shift = np.uint32(32 - (DIMS - 1).bit_length())
    held = np.frombuffer(letters(text), dtype=np.uint8)
    for at in range(0, len(held), BLOCK_BYTES):
        block = held[at:at + BLOCK_BYTES + LONGEST_RUN - 1].astype(np.uint32)  # runs that begin in this block
        begin = min(BLOCK_BYTES, len(held) - at)
        run = np.zeros(begin, dtype=np.uint32)
        for n in range(LONGEST_RUN):
            run = (run[:max(0, min(begin, len(block) - n))] << np.uint32(8)) | block[n:n + begin]
            out += np.bincount(((run + np.uint32(n + 1)) * _MIX[n]) >> shift, minlength=DIMS)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: by the checksum of its id as text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def sample(df: DataFrame, sample_rows: int, text: str, lang: str, key: str) -> DataFrame:
    """(lang, text) of at most ``sample_rows`` training rows a language, chosen by hash."""
    usable = df.where(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(12)).alias("h"))
    # First a share of the rows that is somewhat too large, so that few texts are sorted and shuffled.  The driver holds one number
    # a language here, as the model holds weights for each.
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return usable.select("lang", "text")
    shares = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, (2.0 * sample_rows + 100) / r.n)))
    rows = usable.where((F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.element_at(shares, F.col("lang")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= sample_rows).select("lang", "text")


def _sparse(rows: DataFrame) -> DataFrame:
    """(lang, family, bucket, n): the sample's bucket counts, one row per text with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            seen = [i for i, t in enumerate(batch.column("text").to_pylist()) if has_letter(t)]
            batch = batch.take(pa.array(seen, pa.int64()))
            counts = [run_counts(t) for t in utf8_rows(batch.column("text"))]
            held = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays([
                batch.column("lang"), pa.array([family_of(x) for x in batch.column("lang").to_pylist()], pa.string()),
                pa.array([h.tolist() for h in held], pa.list_(pa.int32())),
                pa.array([c[h].tolist() for c, h in zip(counts, held)], pa.list_(pa.int64()))], names=["lang", "family", "buckets", "ns"])

    return rows.mapInArrow(run, "lang string, family string, buckets array<int>, ns array<bigint>")


def fit_machine(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge), by dual coordinate descent; the last column of ``x`` is one.

    The rarer class costs as much in all as the other.
    """
    share = np.where(y > 0, max((y > 0).sum(), 1), max((y < 0).sum(), 1)) / len(y)
    ease = share / cost  # 1 / (2 C), with C inverse to the class's share
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(y)), (x * x).sum(axis=1) + ease
    order, rng = np.arange(len(y)), np.random.default_rng(12)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            step = max(0.0, alpha[i] - (y[i] * (x[i] @ w) - 1 + ease[i] * alpha[i]) / square[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """Rows of bucket counts as scaled relative frequencies, and a one."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.hstack([counts / total * np.sqrt(DIMS), np.ones((len(counts), 1))])


def _fit_pairs(rows: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], np.ndarray]:
    """A machine for each pair of languages; a pair's sample is one bounded group."""
    listed = F.array(*(F.struct(F.lit(i).alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(pairs)))
    mine = F.filter(listed, lambda p: (p["a"] == F.col("lang")) | (p["b"] == F.col("lang")))
    dealt = rows.select(F.explode(mine).alias("p"), "lang", "buckets", "ns").select(
        "p.pair", (F.col("lang") == F.col("p.a")).alias("first"), "buckets", "ns")

    def fit(table: pa.Table) -> pa.Table:
        x = np.zeros((table.num_rows, DIMS))
        for row, (held, n) in enumerate(zip(table["buckets"].to_pylist(), table["ns"].to_pylist())):
            x[row, held] = n
        y = np.where(table["first"].to_numpy(zero_copy_only=False), 1.0, -1.0)
        order = np.lexsort((*x.T[:8], x.sum(axis=1), y))  # the same machine whatever the order of the rows
        w = fit_machine(_frequencies(x[order]), y[order])
        return pa.table({"pair": table["pair"].slice(0, 1), "w": pa.array([w.astype(np.float32).tolist()], pa.list_(pa.float32()))})

    fitted = dealt.groupBy("pair").applyInArrow(fit, "pair int, w array<float>").collect()
    return {pairs[r.pair]: np.array(r.w, dtype=np.float64) for r in fitted}


def train(df: DataFrame, sample_rows: int = SAMPLE_ROWS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """The model learned from the rows that are not held out."""
    rows = stored(_sparse(sample(df, sample_rows, text, lang, key)), "language-sample")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    grouped: dict[str, list[str]] = {}
    for x in languages:
        grouped.setdefault(family_of(x), []).append(x)
    families = sorted(grouped.items())
    place = {name: i for i, (name, _) in enumerate(families)}
    totals, sizes = np.zeros((len(families), DIMS)), np.zeros(len(families))
    pairs_of = F.explode(F.arrays_zip("buckets", "ns")).alias("z")
    for r in rows.select("family", pairs_of).groupBy("family", "z.buckets").agg(F.sum("z.ns").alias("n")).collect():
        totals[place[r.family], r.buckets] = r.n
    for r in rows.groupBy("family").count().collect():
        sizes[place[r.family]] = r["count"]
    smooth = totals + 0.5
    bayes = np.hstack([np.log(smooth / smooth.sum(axis=1, keepdims=True)), np.log(sizes / max(sizes.sum(), 1)).reshape(-1, 1)])
    pairs = [p for _, members in families for p in combinations(members, 2)]
    return Model(families, bayes, _fit_pairs(rows, pairs) if pairs else {})


def judge(model: Model, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each row of bucket counts."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    # The evidence of a text is that of a text of EVIDENCE runs at most: runs overlap, so they are no independent witnesses.
    logs = counts @ model.bayes[:, :-1].T * (np.minimum(total, EVIDENCE) / total) + model.bayes[:, -1]
    logs -= logs.max(axis=1, keepdims=True)
    chance = np.exp(logs) / np.exp(logs).sum(axis=1, keepdims=True)
    best = chance.argmax(axis=1)
    out, score = [""] * len(counts), chance[np.arange(len(counts)), best]
    for f, (_, members) in enumerate(model.families):
        rows = np.flatnonzero(best == f)
        if not len(rows):
            continue
        wins, margins, sure = (np.zeros((len(rows), len(members))) for _ in range(3))
        x = _frequencies(counts[rows])
        for i, j in combinations(range(len(members)), 2):
            margin = x @ model.machines[members[i], members[j]]
            first = margin > 0
            for at, side, won in ((i, margin, first), (j, -margin, ~first)):
                wins[:, at] += won
                margins[:, at] += side
                sure[:, at] += 1 / (1 + np.exp(-4 * np.clip(side, -50, 50)))
        rank = np.lexsort((np.broadcast_to(-np.arange(len(members)), wins.shape), margins, wins), axis=1)[:, -1]
        for row, k in zip(rows, rank):
            out[row] = members[k]
        if len(members) > 1:
            score[rows] *= sure[np.arange(len(rows)), rank] / (len(members) - 1)
    return out, score


def predict(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(``key``, held_out, lang_pred, score): one row per row of ``df``; only id and text are read."""
    schema = T.StructType([df.schema[key]]).add("held_out", "boolean").add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            seen = np.array([i for i, t in enumerate(batch.column(text).to_pylist()) if model.families and has_letter(t)], dtype=np.int64)
            texts = utf8_rows(batch.column(text))
            for at in range(0, len(seen), 256):
                some = seen[at:at + 256]
                found, scores[some] = judge(model, np.stack([run_counts(texts[i]) for i in some]))
                for i, x in zip(some, found):
                    langs[i] = x
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)],
                                             names=schema.names)

    return df.select(key, held_out(F.col(key)).alias("held_out"), text).mapInArrow(run, schema)
