"""Operator 7: totals against recounting."""

import random
from collections import defaultdict

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from replaylab.llm import queries, rollups
from replaylab.llm._common import scratch

CHANGES = "change string, source string, lang string, tokenizer string, n_tokens long, old_tokens long, n_docs int, batch int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 9) for r in rows], CHANGES)


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_query_on_documents(spark, sf_mid):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    first = {}
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet").collect()
    for d in sorted(docs, key=lambda d: d.doc_id):
        first.setdefault(d.text or "", d)
    want = defaultdict(lambda: [0, 0])
    for text, d in first.items():
        want[d.source, d.lang, "byte_bpe_50k"][0] += 1
        want[d.source, d.lang, "byte_bpe_50k"][1] += len(tok.encode(text, add_special_tokens=False).ids) + 1
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in queries.op7_token_counts(spark, sf_mid).collect()}
    assert got == dict(want)
    assert len(first) < len(docs)


def test_batches_are_idempotent_and_reversible(spark):
    rnd = random.Random(8)
    store, want, live = rollups.TokenRollup(spark, scratch(spark, "t")), defaultdict(lambda: [0, 0]), []
    for batch in range(4):
        rows = []
        for _ in range(30):
            group = (rnd.choice(["a", "b", None]), rnd.choice(["en", None]), rnd.choice(["v1", "v2"]))
            if live and rnd.random() < 0.4:
                i = rnd.randrange(len(live))
                group, n = live[i]
                if rnd.random() < 0.5:
                    rows.append(("delete", *group, n, None))
                    del live[i]
                    want[group][0] -= 1
                    want[group][1] -= n
                else:
                    rows.append(("revise", *group, n + 5, n))
                    live[i] = (group, n + 5)
                    want[group][1] += 5
            else:
                n = rnd.randrange(50)
                rows.append(("insert", *group, n, None))
                live.append((group, n))
                want[group][0] += 1
                want[group][1] += n
        for _ in range(1 + batch % 2):
            store.commit(f"b{batch}", frame(spark, rows))
    expected = {g: tuple(v) for g, v in want.items() if any(v)}
    assert totals(store) == expected
    store.commit("empty", frame(spark, []))
    store.commit("undo", frame(spark, [("delete", *g, n, None) for g, n in live]))
    assert totals(store) == {}


def test_odd_changes(spark):
    store = rollups.TokenRollup(spark, scratch(spark, "t"))
    store.commit("x", frame(spark, [("insert", None, None, None, None, None), ("insert", None, None, None, 3, None)]))
    assert totals(store) == {(None, None, None): (2, 3)}
    with pytest.raises(Exception, match="unknown change"):
        rollups.signed(frame(spark, [("upsert", "a", "b", "c", 1, 1)])).collect()
    with pytest.raises(ValueError):
        store.commit("../x", frame(spark, []))


def test_differences_lead_from_old_to_new(spark):
    schema = "doc_id long, source string, lang string, tokenizer string, n_tokens long, extra int"
    old = [(1, "a", "en", "v", 5, 0), (2, "a", "en", "v", 7, 0), (3, "b", None, "v", 1, 0), (4, "b", "en", "v", 2, 0)]
    new = [(1, "a", "en", "v", 6, 0), (3, "c", None, "v", 1, 0), (4, "b", "en", "v", 2, 0), (5, None, None, "v", 9, 0), (1, "a", "en", "w", 3, 0)]
    make = lambda rows: spark.createDataFrame(rows, schema)
    store = rollups.TokenRollup(spark, scratch(spark, "t"))
    none = make([])
    store.commit("1", rollups.differences(none, make(old)))
    store.commit("2", rollups.differences(make(old), make(new)))
    want = defaultdict(lambda: [0, 0])
    for _, s, lang, t, n, _ in new:
        want[s, lang, t][0] += 1
        want[s, lang, t][1] += n
    assert totals(store) == {k: tuple(v) for k, v in want.items()}


def test_new_store_half_written_batch_and_compaction(spark):
    store = rollups.TokenRollup(spark, scratch(spark, "t"))
    assert totals(store) == {}
    for i in range(6):
        store.commit(f"b{i}", frame(spark, [("insert", "a", "en", "v", i, None)]))
    # Died before its marker: rows without one, and an attempt of a committed batch.
    rollups.signed(frame(spark, [("insert", "a", "en", "v", 99, None)])).selectExpr("*", "'b3' as batch").write.parquet(f"{store.path}/attempt=dead")
    assert totals(store) == {("a", "en", "v"): (6, 15)}
    assert store.compact() == 6 and totals(store) == {("a", "en", "v"): (6, 15)}
    store.commit("b3", frame(spark, [("insert", "a", "en", "v", 10, None)]))
    assert totals(store) == {("a", "en", "v"): (6, 22)}
