"""Operator 5 against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from replaylab.llm import components, queries, simhash


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    fps = np.array(fps, dtype=np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 2) + i + 1:
            root[find(int(j))] = find(i)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_query_on_documents(spark, sf_mid):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_mid}/documents.parquet").collect())
    fps = [brute_fingerprint(t) for _, t in docs]
    want = list(zip([d for d, _ in docs], [f"{f:016x}" for f in fps], brute_components([d for d, _ in docs], fps)))
    assert sorted(map(tuple, queries.op5_simhash(spark, sf_mid).collect())) == want
    assert len({c for _, _, c in want}) < len(want)


def test_crowded_buckets_lose_no_link(spark):
    rnd = random.Random(3)
    centre = rnd.getrandbits(64)
    fps = {centre}
    while len(fps) < 900:  # a chain-like cloud around one fingerprint
        f = rnd.choice(sorted(fps)[:200]) if rnd.random() < 0.5 else centre
        for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4])):
            f ^= 1 << b
        fps.add(f)
    fps |= {rnd.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    for bucket in (256, 8):
        found = components.components(simhash.links(classes, bucket=bucket), "t")
        groups = {}
        for node, root in found.collect():
            groups.setdefault(root, set()).add(node)
        want = {}
        for f, c in zip(signed, brute_components(list(range(len(fps))), fps)):
            want.setdefault(c, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_edge_rows(make_docs):
    long = "Word " * 50_000
    df = make_docs([(5, None), (4, ""), (9, " \n"), (7, "a b"), (6, "A\tB"), (None, "a b"), (8, long), (8, long)])
    rows = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in rows) == [
        (False, 4, 4), (False, 5, 4), (False, 6, 6), (False, 7, 6), (False, 8, 8), (False, 8, 8), (False, 9, 4), (True, 0, 6)]
    assert {r.fingerprint for r in rows if r.component_id == 4} == {"0" * 16}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.kept_documents(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where(F.col("doc_id").isNotNull()).collect()) == [4, 6, 8]


def test_one_row_of_each_group_stays_whatever_the_ids(make_docs):
    a, b, c = ("alpha beta gamma delta epsilon " * 9, "one two three four five six seven " * 9, "red green blue white black " * 9)
    kept = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in simhash.kept_documents(make_docs(rows)).collect())
    assert kept([(1, a), (2, a), (1, b), (0, b)]) == [(False, 0, b), (False, 1, a)]
    assert kept([(8, a), (8, a), (None, b), (None, b), (None, c), (5, c)]) == [(False, 5, c), (False, 8, a), (True, 0, b)]
    assert kept([]) == []
