"""Quality rules: gradient-boosted trees over document statistics (operator 3).

Method.
1. Document statistics from the whole text (``STATISTICS``), per Arrow batch, without a shuffle.
2. Two plain base rules: too few words, or too many words in repeated 8-word windows.
3. A gradient-boosted tree model, trained here on labelled documents and flattened into numpy node arrays, scores every
   document in the same pass.  The score may only move one way with the features that measure damage (``DIRECTIONS``), so
   more symbols, shouting or repetition never raises it.

Training takes a bounded sample of labelled rows: the ``sample_rows`` (default ``SAMPLE_ROWS``) labels with the smallest
hash of their id.  Only their statistics reach the driver.  Everything else covers all documents.

Defined results: a null or empty text has no words, so its counts are zero and it fails the base rules.  Repeated rows are
scored each.  Null ids are kept.  Labels with a null quality or id, or without a document, are ignored; with fewer than ``MIN_LABELS``
labels of either kind the verdict is that of the base rules alone.  Extra columns are not read by ``score``, and ``keep``
passes them through, whatever their names.  Empty tables give empty results.  Very long texts are handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from replaylab.llm import boosting
from replaylab.llm._common import slices, utf8_rows

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SAMPLE_ROWS = 20_000
MIN_LABELS = 30
#: A document is rejected if the model's probability of good quality is below this.
THRESHOLD = 0.3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature -> direction in which the score may move with it (0: free).
DIRECTIONS = {
    "symbol_share": -1, "dup_line_share": -1, "repeat_word_share": -1, "upper_share": -1, "mark_share": -1,
    "lone_mark_share": -1, "digit_share": -1, "distinct_word_share": 1, "alpha_share": 1, "long_word_share": -1,
}
STATISTICS = tuple(DIRECTIONS)

_is = lambda chars: np.isin(np.arange(256), list(chars))
_SYMBOL, _BLANK = _is(b"#*$%&|<>"), _is(b" \t\n\v\f\r")
_UPPER, _LOWER, _DIGIT = _is(range(65, 91)), _is(range(97, 123)), _is(range(48, 58))
_LATER = _is(range(0x80, 0xC0))  # bytes of a code point after its first
_MARK = _is([b for b in range(33, 127) if not chr(b).isalnum()]) & ~_is(b".,;:'\"-()")


def _repeated_words(words: list[bytes]) -> int:
    """Words inside a window of ``WINDOW`` words that occurs twice or more, first occurrences included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    # A sum over hashes sorts out texts without any repeat; a repeat of the sum is then checked word by word.
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    total, factor = np.zeros(n, dtype=np.uint64), 1
    for k in range(WINDOW):
        total += hashes[k:k + n] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
    order = np.sort(total)
    if not (order[1:] == order[:-1]).any():
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    span = 1
    while span < WINDOW:  # numbers of windows of 2, 4 and 8 words
        pairs = ids[:-span] * (ids.max() + 1) + ids[span:]
        distinct, ids, times = np.unique(pairs, return_inverse=True, return_counts=True)
        span *= 2
    found = np.flatnonzero(times[ids] > 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, found, 1)
    np.add.at(edges, found + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def statistics(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts (``COUNTS``) and the model's features (``STATISTICS``) of a UTF-8 text."""
    by_byte = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    count = lambda mask: int(by_byte[mask].sum())
    words = text.split()
    n_words = len(words)
    word_chars = len(text) - count(_LATER) - count(_BLANK)
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_dup = len(lines) - len(set(lines))
    counts = (n_words, word_chars, count(_SYMBOL), n_dup, _repeated_words(words))
    chars, some = max(word_chars, 1), max(n_words, 1)
    upper, lower, marks = count(_UPPER), count(_LOWER), count(_MARK)
    alpha = word_chars - count(_DIGIT) - count(_is_ascii_mark)
    features = (counts[2] / chars, n_dup / max(len(lines), 1), counts[4] / some, upper / max(upper + lower, 1), marks / chars,
                sum(1 for w in words if len(w) == 1 and _MARK[w[0]]) / some, count(_DIGIT) / chars, len(set(words)) / some,
                alpha / chars, sum(1 for w in words if len(w) > 40) / some)
    return counts, features


_is_ascii_mark = _is([b for b in range(33, 127) if not chr(b).isalnum()])


def _arrays(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    found = [statistics(t) for t in utf8_rows(batch.column(text))]
    counts = np.array([c for c, _ in found], dtype=np.int64).reshape(-1, len(COUNTS))
    return counts, np.array([f for _, f in found], dtype=np.float64).reshape(-1, len(STATISTICS))


def _sample(df: DataFrame, labels: DataFrame, sample_rows: int, text: str, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample of labelled documents, collected to the driver."""
    chosen = (labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).select(key, F.col("quality").cast("int").alias("quality"))
              .distinct().orderBy(F.xxhash64(F.col(key), F.lit(3)), key, "quality").limit(sample_rows))
    # Broadcast: at most sample_rows rows of two numbers.
    rows = df.select(key, text).join(F.broadcast(chosen), key)
    schema = T.StructType([df.schema[key]]).add("quality", "integer").add("features", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            _, features = _arrays(batch, text)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("quality"), pa.array(list(features), pa.list_(pa.float64()))],
                                             names=schema.names)

    # Rows that repeat an id count once, so the sample stays bounded and the same on every run.
    found = rows.mapInArrow(run, schema).groupBy(key, "quality").agg(F.min("features").alias("features")).collect()
    return np.array([r.features for r in found], dtype=np.float64).reshape(-1, len(STATISTICS)), np.array([r.quality for r in found])


def train(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, text: str = "text", key: str = "doc_id") -> boosting.Trees | None:
    """The model, or None if the labels don't suffice."""
    x, y = _sample(df, labels, sample_rows, text, key)
    good = y == 1
    if min(good.sum(), (~good).sum()) < MIN_LABELS:
        return None
    order = np.lexsort((y, *x.T))  # the same model whatever the order of the rows
    return boosting.fit(x[order], good[order].astype(np.float64), np.array(list(DIRECTIONS.values())))


def score(df: DataFrame, model: boosting.Trees | None, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(``key``, the base counts, base_failed, quality_score, kept): one row per row of ``df``."""
    schema = T.StructType([df.schema[key]])
    for name in COUNTS:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("quality_score", "double").add("kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            counts, failed, good = judge(batch, text, model)
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(good),
                                              pa.array(~failed & (good >= threshold))], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def judge(batch: pa.RecordBatch, text: str, model: boosting.Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base rules' verdict and probability of good quality of a batch's rows."""
    counts, features = _arrays(batch, text)
    n_words, repeated = counts[:, 0], counts[:, 4]
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
    good = 1 / (1 + np.exp(-model.margin(features))) if model is not None else np.ones(len(counts))
    return counts, failed, good


def keep(df: DataFrame, model: boosting.Trees | None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``df`` that pass, all columns as they are; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            _, failed, good = judge(batch, text, model)
            yield batch.filter(pa.array(~failed & (good >= threshold)))

    return df.mapInArrow(run, df.schema)
