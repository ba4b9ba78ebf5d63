"""Operator 8: SQL oracle, brute force on odd rows, reversible state, cuckoo filter."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from replaylab.llm import line_dedup, queries
from replaylab.llm._common import scratch
from replaylab.llm.cuckoo import CuckooFilter

BLANKS = " \t\n\v\f\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(docs):
    """(doc_id, text) rows -> (doc_id, n_lines, n_dropped, kept text)."""
    held = defaultdict(set)
    for row, (_, text) in enumerate(docs):
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 20:
                held[key_of(line)].add(row)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            rows = held.get(key_of(line), ())
            ids = [docs[r][0] for r in rows if docs[r][0] is not None]
            if len(rows) < 3 or doc_id == (max(ids) if ids else None):
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_query_matches_sql(spark, sf_mid):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_mid}/documents.parquet'")
    want = con.execute(queries.ORACLE["op8_line_dedup"]).fetchall()
    got = [tuple(r) for r in queries.op8_line_dedup(spark, sf_mid).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[2] for r in got) > 0


def odd_docs():
    long, other = "This line is surely long enough", "Äußerst lange Zeile über öde Wörter"
    return [(1, f"{long}\nshort\n\n{other}"), (2, f"  {long.upper()}\t\nx"), (3, f"{long}\r\n{long}\n{other}"), (4, None), (5, ""),
            (6, f"{other}\n" * 3), (6, f"{other}\nown line of this document here"), (None, f"{long}\nz"), (7, "\n\n\n"),
            (8, "a" * 19), (9, "a" * 19), (10, "a" * 19), (11, "ö" * 20), (12, "ö" * 20), (13, "ö" * 20),
            (14, "\n".join(f"line number {i} of a very long document" for i in range(3000)))]


def test_odd_rows(make_docs):
    df = make_docs(odd_docs())
    got = line_dedup.dedup(df)
    assert got.columns[:-1] == df.columns
    rows = [(r.doc_id, r.line_dedup.n_lines, r.line_dedup.n_dropped, r.text) for r in got.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(rows, key=order) == sorted(brute(odd_docs()), key=order)
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_many_shards_and_salts(make_docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    rnd = random.Random(5)
    pool = [f"shared sentence number {i} with some words" for i in range(40)]
    docs = [(i, "\n".join(rnd.choices(pool, k=rnd.randrange(1, 9)) + [f"own sentence of the document {i}"])) for i in range(120)]
    rows = [(r.doc_id, r.line_dedup.n_lines, r.line_dedup.n_dropped, r.text) for r in line_dedup.dedup(make_docs(docs)).collect()]
    assert sorted(rows) == brute(docs)


def shards_of(store):
    return {r.shard: r.filter for r in store.filters().collect()}


def marks(found):
    """All marks held by filters, whatever their places."""
    held = [CuckooFilter.from_bytes(bytes(f)).slots for f in found.values()]
    return sorted(np.sort(s[s > 0]).tolist() for s in held if s.any())


def test_store_is_incremental_and_reversible(spark, make_docs):
    first = [(i, f"common line for everybody here\nown line of document {i} is this") for i in range(4)]
    second = [(10 + i, "common line for everybody here\nanother shared line of the batch") for i in range(3)]
    store = line_dedup.LineStore(spark, scratch(spark, "store"))
    nothing = store.clean(make_docs(first))
    assert sorted((r.doc_id, r.text) for r in nothing.collect()) == first
    assert store.commit("a", make_docs(first), 1)
    before, filters = sorted(map(tuple, store.repeated().collect())), shards_of(store)
    assert len(filters) == 1 and [r[1] for r in before] == [4]
    assert store.commit("b", make_docs(second), 1)
    assert not store.commit("b", make_docs(second), 1)  # once more: no change
    assert sorted(r.n_docs for r in store.repeated().collect()) == [3, 7]
    grown = shards_of(store)
    touched = {s for s in grown if grown[s] != filters.get(s)}
    lines = store.repeated().select(line_dedup._shard(store.n_shards).alias("shard"), "n_docs").collect()
    assert touched == {r.shard for r in lines if r.n_docs == 3}  # the line that was repeated before moved no filter
    for _ in range(2):
        cleaned = store.clean(make_docs(first + second))
        assert sorted((r.doc_id, r.text) for r in cleaned.collect()) == sorted((d, t) for d, _, _, t in brute(first + second))
        store.compact()
    assert store.commit("c", make_docs(second), -1)
    assert sorted(map(tuple, store.repeated().collect())) == before
    assert marks(shards_of(store)) == marks(filters)
    assert store.commit("d", make_docs(first), -1) and store.repeated().count() == 0 and marks(shards_of(store)) == []


def test_store_after_a_commit_that_died(spark, make_docs, monkeypatch):
    docs = [(i, f"common line for everybody here\nown line of document {i} is this") for i in range(4)]
    store = line_dedup.LineStore(spark, scratch(spark, "store"))
    publish = line_dedup.published.publish

    def dies(df, path, *args, **kw):
        if path.endswith("/counts"):
            raise OSError("lost")
        publish(df, path, *args, **kw)

    monkeypatch.setattr(line_dedup.published, "publish", dies)
    with pytest.raises(OSError):
        store.commit("a", make_docs(docs), 1)
    assert store.repeated().count() == 0 and store.batches() == set()
    assert sorted((r.doc_id, r.text) for r in store.clean(make_docs(docs)).collect()) == docs
    monkeypatch.setattr(line_dedup.published, "publish", publish)
    assert store.commit("a", make_docs(docs), 1)
    assert sorted((r.doc_id, r.text) for r in store.clean(make_docs(docs)).collect()) == sorted((d, t) for d, _, _, t in brute(docs))


def test_clashing_names_and_rows_without_ids(spark, make_docs):
    docs = [(None, f"a line that all of these hold\nown words of the row number {i}") for i in range(40)] + [(1, "a line that all of these hold")]
    df = make_docs(docs).withColumnRenamed("component_id", "line_dedup")
    got = line_dedup.dedup(df)
    assert got.columns == [*df.columns, "line_dedup_"] and {r.line_dedup for r in got.collect()} == {-1}
    assert sorted(r.text for r in got.collect()) == sorted(t for _, _, _, t in brute(docs))


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    held = CuckooFilter.of(keys)
    assert held.contains(keys).all()
    others = rng.integers(0, 1 << 64, 20000, dtype=np.uint64)
    assert held.contains(others).mean() < 0.01
    assert all(held.delete(k) for k in keys[:2500].tolist())
    again = CuckooFilter.from_bytes(held.to_bytes())
    assert again.contains(keys[2500:]).all()
    assert again.contains(keys[:2500]).mean() < 0.01
    full = CuckooFilter(1)
    assert sum(full.insert(k) for k in keys[:10].tolist()) <= 4


def test_digest_columns(spark, make_docs):
    assert hashlib.sha256(b"").hexdigest() in {
        r.h for r in line_dedup.dedup(make_docs([(1, None)])).selectExpr("sha2(text, 256) as h").collect()}
