"""Operator 11: brute force, exact plane sums, odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np

from replaylab.llm import importance, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute(docs, target):
    """[(doc_id, n_features, weight, score, rank)] by the definition, one feature at a time."""
    s, t = [0] * 10000, [0] * 10000
    for _, text in docs:
        for b in features(text)[1]:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows, able = [], []
    for doc_id, text in docs:
        n_words, found = features(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None])
        if n_words >= 20:
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[:5 * len(able) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_matches_brute_force(spark, sf_mid):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_mid}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_mid}/benchmark.parquet").select("text").collect()]
    rows = got(queries.op11_importance(spark, sf_mid))
    assert rows == brute(docs, target)
    assert sum(r[4] is not None for r in rows) > 10


def test_odd_rows(spark, make_docs):
    rnd = random.Random(11)
    words = ["Ab", "ß", "Éa", "x9", "a_b", "[", "\x7f", "日本", "ZZ", "q" * 50]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randrange(80)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "  \n"), (None, "one two " * 20), (None, None), (7, docs[7][1]), (7, docs[7][1])]
    docs += [(200 + i, "same words here and there again " * 5) for i in range(30)]
    target = spark.createDataFrame([("Ab x9 日本",), (None,), ("",)], "text string")
    assert got(importance.resample(make_docs(docs), target)) == brute(docs, ["Ab x9 日本", None, ""])


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "text string")
    assert got(importance.resample(make_docs([]), none)) == []
    docs = [(i, "a b c d e " * 5 + str(i)) for i in range(40)]
    assert got(importance.resample(make_docs(docs), none)) == brute(docs, [])


def test_blocks_of_words_change_nothing(monkeypatch):
    text = " ".join(random.Random(1).choices(["a", "bb", "ccc", "é"], k=5000)).encode()
    whole = importance.bucket_counts(text)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(importance, "BLOCK_WORDS", size)
        n, counts = importance.bucket_counts(text)
        assert n == whole[0] and (counts == whole[1]).all()


def test_plane_sums_are_exact():
    rng = np.random.default_rng(2)
    for low, high in ((-9, 10), (0, 5), (-20000, 1), (-8, 8), (-1, 0), (3, 4)):
        gains = rng.integers(low, high, 10000)
        counts = [rng.poisson(r, 10000) for r in (0, 0.01, 1, 300)]
        planes = importance.gain_planes(gains)
        assert importance.plane_weights([importance.count_planes(c) for c in counts], planes).tolist() == [int(c @ gains) for c in counts]
