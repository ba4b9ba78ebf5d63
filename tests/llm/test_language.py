"""Operator 12: held-out accuracy, what predictions depend on, odd rows, the machines themselves."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from replaylab.llm import language, queries


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_held_out_accuracy(spark, sf_mid):
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = rows_of(queries.op12_language(spark, sf_mid))
    assert len(got) == len(docs)
    right = {True: [], False: []}
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in {"de", "en", "es", "fr", "und"}
        if d.lang is not None and d.text and any(c.isalpha() for c in d.text):
            right[r.held_out].append(r.lang_pred == d.lang)
    assert len(right[True]) > 200 and np.mean(right[True]) > 0.99


def made_docs(n=240):
    """Texts over four alphabets of syllables; two are close to each other."""
    rnd = random.Random(12)
    syllables = {"en": "th an er ou st", "de": "th an er sch ung", "xx": "zu ko mi ra ta", "fr": "que é oi eau la"}
    return [(i, " ".join("".join(rnd.choices(syllables[x].split(), k=3)).capitalize() for _ in range(rnd.randrange(4, 40))), x)
            for i in range(n) for x in [rnd.choice(sorted(syllables))]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "x", -1, 0.5) for r in rows],
                                 "doc_id long, text string, lang string, source string, family string, bucket int, score double")


def test_only_the_text_decides(spark):
    rows = made_docs()
    model = language.train(frame(spark, rows))
    assert [f for f, _ in model.families] == ["germanic", "other", "romance"] and set(model.machines) == {("de", "en")}
    got = rows_of(language.predict(frame(spark, rows), model))
    assert np.mean([got[i].lang_pred == x for i, _, x in rows]) > 0.97
    other = rows_of(language.predict(frame(spark, [(i + 7000, t, None) for i, t, _ in rows]), model))
    assert all((other[i + 7000].lang_pred, other[i + 7000].score) == (got[i].lang_pred, got[i].score) for i, _, _ in rows)
    # Held-out rows' languages are never learned from.
    lying = [(i, t, "fr" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in rows]
    again = language.train(frame(spark, lying))
    assert (again.bayes == model.bayes).all() and all((again.machines[p] == w).all() for p, w in model.machines.items())


def test_odd_rows(spark):
    rows = made_docs() + [(None, "thaner thouth", "en"), (None, None, None), (901, None, "de"), (902, "", "de"), (903, " 12 !? ²\n", "en"),
                          (904, "É", None), (905, "日本", None), (906, "thaner " * 200_000, None), (907, "x\x00y", ""), (3, "quela", "fr"), (3, "quela", "fr")]
    df = frame(spark, rows)
    got = language.predict(df, language.train(df)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id > 900}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (901, 902, 903))
    assert all(by_id[i].lang_pred != "und" for i in (904, 905, 906, 907))
    assert sorted((r.held_out, r.lang_pred == "und") for r in got if r.doc_id is None) == [(False, False), (False, True)]
    assert len({tuple(r) for r in got if r.doc_id == 3 and r.lang_pred == "fr"}) == 1


def test_nothing_to_learn_from(spark):
    assert language.predict(frame(spark, []), language.train(frame(spark, []))).count() == 0
    rows = [(i, "some words", None) for i in range(8)]
    got = language.predict(frame(spark, rows), language.train(frame(spark, rows))).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    one = [(i, "some words", "en") for i in range(8)]
    got = language.predict(frame(spark, one), language.train(frame(spark, one))).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("en", 1.0)}


def test_sample_is_bounded_and_even(spark):
    rows = [(i, f"text {i}", "en" if i % 50 else "de") for i in range(5000)]
    n = {r.lang: r["count"] for r in language.sample(frame(spark, rows), 60, "text", "lang", "doc_id").groupBy("lang").count().collect()}
    held = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(0, 5000, 50))
    assert n == {"en": 60, "de": min(60, held)}
    all_alike = [(1, "same", "en")] * 500
    assert language.sample(frame(spark, all_alike), 60, "text", "lang", "doc_id").count() <= 60
    out = language.sample(frame(spark, rows).withColumn("doc_id", F.lit(None).cast("long")), 60, "text", "lang", "doc_id")
    assert out.count() == 120 or out.count() > 60


def test_counts_by_brute_force(monkeypatch):
    text = ("Straße No1 -- ÉCOLE été\t" * 40).encode()
    runs = {}
    held = language.letters(text)
    assert held.startswith(" straße no ".encode()) and b"  " not in held
    for n in range(1, language.LONGEST_RUN + 1):
        for i in range(len(held) - n + 1):
            runs[held[i:i + n]] = runs.get(held[i:i + n], 0) + 1
    want = np.zeros(language.DIMS, dtype=np.int64)
    for run, times in runs.items():
        value = int.from_bytes(run, "big") + len(run)
        want[(value * int(language._MIX[len(run) - 1]) & 0xFFFFFFFF) >> (32 - (language.DIMS - 1).bit_length())] += times
    for size in (1 << 19, 64, 5, 1):
        monkeypatch.setattr(language, "BLOCK_BYTES", size)
        assert (language.run_counts(text) == want).all()


def test_machine_separates():
    rng = np.random.default_rng(1)
    x = np.hstack([rng.standard_normal((300, 12)), np.ones((300, 1))])
    y = np.where(x[:, 0] + 0.3 * x[:, 3] + 0.2 > 0, 1.0, -1.0)
    w = language.fit_machine(x, y)
    assert (np.sign(x @ w) == y).mean() > 0.97
