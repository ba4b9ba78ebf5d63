"""Target-distribution importance resampling with bit-sliced aggregation (operator 11).

Method.
1. A text's features are its runs of one to three words, hashed to ``BUCKETS`` buckets; a run's checksum goes on from that of the
   run without its last word, so each feature costs one checksum of one word.
2. Bucket totals of the corpus and of the target are sums over tasks' own totals, one row per bucket and task.  From them comes one
   whole-number gain per bucket: the scaled log ratio of the target's to the corpus's smoothed frequency.
3. The gains are sliced into signed bit planes: plane ``j`` holds bit ``j`` of every bucket's gain in two's complement, so the
   highest one counts negatively.  A document's bucket counts are sliced alike: plane ``i`` holds bit ``i`` of every count.
   The weight, the sum of count times gain, is the sum of ``2^i * 2^j`` (minus for the highest ``j``) times the number
   of bits that plane ``i`` AND plane ``j`` share.  It is exact, and rare counts over one cost a plane only where they occur.
4. Weights plus Gumbel noise, fixed by the id, are scores; the highest scores are drawn.  Ranks come from a sort by range: each
   range numbers its own rows and adds the number of rows in the ranges before.

The gains (one number per bucket) and the ranges' sizes are all that reaches the driver.  A text goes through in blocks of words,
so a very long one needs no more memory than its words.

Defined results: a null or empty text has no feature and weight zero.  Rows that repeat are documents of their own, with equal
scores and adjacent ranks.  A null id is read as an empty one for the noise, and loses ties.  Only the id and text columns are read,
whatever the others' names.  An empty corpus gives none; an empty target is smoothed like any other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from replaylab.llm._common import slices, stored, utf8_rows

BUCKETS = 10_000
SCALE = 1000
#: Share of the documents that is drawn, in percent, among those with at least ``MIN_WORDS`` words.
PERCENT = 5
MIN_WORDS = 20
SEED = 42
#: Words of a text handled at once.
BLOCK_WORDS = 1 << 17
#: On UTF-8 bytes after lower-casing A-Z: digits, letters, and all bytes of other characters.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def bucket_counts(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and how many features fall into each bucket."""
    text = text.lower()  # on bytes: A-Z only
    found = (m.group() for m in _WORD.finditer(text)) if len(text) > 16 * BLOCK_WORDS else iter(_WORD.findall(text))
    total, n_words, before = np.zeros(buckets, dtype=np.int64), 0, []
    while block := list(islice(found, BLOCK_WORDS)):
        n_words += len(block)
        words = before + block  # runs may begin in the block before
        spaced = [b" " + w for w in words]
        one = list(map(crc32, words))
        two = list(map(crc32, spaced[1:], one))
        three = list(map(crc32, spaced[2:], two))
        k = len(before)
        new = one[k:] + two[max(0, k - 1):] + three[max(0, k - 2):]
        total += np.bincount(np.array(new, dtype=np.int64) % buckets, minlength=buckets)
        before = words[-2:]
    return n_words, total


def bucket_totals(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows; a task sends one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for t in utf8_rows(batch.column(text)):
                total += bucket_counts(t, buckets)[1]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in df.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole-number gain of each bucket, from the bucket totals."""
    buckets, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(SCALE * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
                     for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def _words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def gain_planes(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed bit planes of the gains (two's complement) and each plane's value."""
    width = max(int(gains.max()).bit_length(), int(-gains.min() - 1).bit_length() if gains.min() < 0 else 0) + 1
    planes = _words_of((gains[None, :] >> np.arange(width)[:, None]) & 1 == 1)
    values = np.array([1 << j for j in range(width - 1)] + [-(1 << (width - 1))], dtype=np.int64)
    return planes, values


def count_planes(counts: np.ndarray) -> np.ndarray:
    """Bit planes of one document's bucket counts."""
    held = np.flatnonzero(counts)
    n = counts[held]
    bits = np.zeros((int(n.max()).bit_length() if len(n) else 0, len(counts)), dtype=bool)
    for i, row in enumerate(bits):
        row[held[(n >> i) & 1 == 1]] = True
    return _words_of(bits)


def plane_weights(planes: list[np.ndarray], gains: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Each document's weight from its count planes: AND, popcount, and sums of powers of two."""
    sizes = np.array([len(p) for p in planes], dtype=np.int64)
    rows = np.concatenate(planes) if len(planes) else np.zeros((0, gains[0].shape[1]), np.uint64)
    shared = np.zeros(len(rows), dtype=np.int64)
    for plane, value in zip(*gains):
        shared += value * np.bitwise_count(rows & plane).sum(axis=1, dtype=np.int64)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    shared <<= np.arange(len(rows)) - starts  # a document's plane i counts 2^i times
    out = np.zeros(len(sizes), dtype=np.int64)
    np.add.at(out, np.repeat(np.arange(len(sizes)), sizes), shared)
    return out


def weights(df: DataFrame, gains: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(``key``, n_words, n_features, weight): one row per row of ``df``."""
    schema = T.StructType([df.schema[key]]).add("n_words", "long").add("n_features", "long").add("weight", "long")
    sliced, buckets = gain_planes(gains), len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            found = [(n, int(counts.sum()), count_planes(counts)) for n, counts in (bucket_counts(t, buckets) for t in utf8_rows(batch.column(text)))]
            n_words, n_features, planes = zip(*found)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                                              pa.array(plane_weights(list(planes), sliced))], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def noise(key: Column, seed: int = SEED) -> Column:
    """Scaled Gumbel noise, fixed by the id: a long."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / F.lit(float(1 << 32)))))


def ranked(scored: DataFrame, n_drawn: int, key: str = "doc_id") -> DataFrame:
    """``scored`` with ``rank`` of the ``n_drawn`` highest scores (1 first, ties to the smaller id), null for the others."""
    order = [F.desc("score"), F.col(key).asc_nulls_last()]
    ranges = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    ranges = stored(ranges, "importance-ranges").withColumn("range", F.shiftright("seq", 33))
    # One row per range; the first number of a range is its id shifted up.
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("seq").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranges.join(before, "range").withColumn("rank", F.when(rank <= n_drawn, rank)).drop("seq", "range", "before")


def resample(df: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", percent: int = PERCENT,
             min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(``key``, n_words, n_features, weight, score, rank): every row of ``df``; ``rank`` is null unless drawn."""
    gains = bucket_gains(bucket_totals(df, text, buckets), bucket_totals(target, target_text, buckets))
    scored = weights(df, gains, text, key).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    scored = stored(scored, "importance-scores")
    enough = F.col("n_words") >= min_words
    drawn = ranked(scored.where(enough), percent * scored.where(enough).count() // 100, key)
    return drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
