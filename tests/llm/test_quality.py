"""Operator 3: statistics against brute force, monotonic trees, held-out accuracy."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from replaylab.llm import boosting, quality, queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            inside |= set(range(i, i + 8))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside),
            n < 20 or 100 * len(inside) > 30 * n)


def test_query_on_documents(spark, sf_mid):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_mid}/documents.parquet").collect()}
    rows = queries.op3_quality(spark, sf_mid).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_counts_of_odd_texts():
    rnd = random.Random(3)
    texts = ["", " ", None, "a", "a " * 30, "a b c d e f g h " * 2, "a b c d e f g h a b c d e f g", "\n\n \n\t\n", "x\nx\n x\nx\x0b\n", "é\x85\xa0ü w", "#|<>" * 9]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(60))) + "\n" * rnd.randrange(3) for _ in range(200)]
    texts.append("word " * 300_000)
    for t in texts:
        counts, features = quality.statistics((t or "").encode())
        want = brute(t) if len(t or "") < 10_000 else (300_000, 1_200_000, 0, 0, 300_000, True)
        assert counts == want[:5], t[:60]
        assert np.isfinite(features).all()


def test_edge_rows(spark, make_docs):
    df = make_docs([(1, None), (2, ""), (None, "good words " * 3), (3, "one two three four five six seven eight nine ten " + " ".join(f"w{i}" for i in range(30))), (3, "x")])
    labels = spark.createDataFrame([(3, 1, 0), (3, None, 0), (None, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    assert model is None  # too few labels: base rules alone
    rows = quality.score(df, model).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in rows) == [(0, 6, False), (1, 0, False), (2, 0, False), (3, 1, False), (3, 40, True)]
    kept = quality.keep(df, model)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [3]
    assert quality.score(df.limit(0), model).count() == 0
    assert quality.train(df, labels.limit(0)) is None


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return quality._sample(docs, labels, 20_000, "text", "doc_id")


def test_held_out_accuracy(labelled):
    x, y = labelled
    fold = np.random.default_rng(0).integers(0, 4, len(y))
    model = boosting.fit(x[fold > 0], (y[fold > 0] == 1).astype(float), np.array(list(quality.DIRECTIONS.values())))
    good = 1 / (1 + np.exp(-model.margin(x[fold == 0]))) >= quality.THRESHOLD
    truth = y[fold == 0] == 1
    assert good[truth].mean() > 0.97  # good documents stay
    assert (~good)[~truth].mean() > 0.85  # bad ones go


def test_score_is_monotonic(labelled):
    x, y = labelled
    directions = np.array(list(quality.DIRECTIONS.values()))
    model = boosting.fit(x, (y == 1).astype(float), directions, trees=30)
    rng = np.random.default_rng(1)
    rows = x[rng.integers(0, len(x), 300)]
    for f in np.flatnonzero(directions):
        grid = np.linspace(x[:, f].min(), x[:, f].max(), 40)
        scores = []
        for value in grid:
            changed = rows.copy()
            changed[:, f] = value
            scores.append(model.margin(changed))
        steps = np.diff(np.array(scores), axis=0) * directions[f]
        assert (steps >= -1e-9).all()


def test_flat_trees_match_a_walk():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(400, 3)), rng.integers(0, 2, 400).astype(float)
    model = boosting.fit(x, y, np.zeros(3), trees=7, least_rows=5)
    for row, score in zip(x[:50], model.margin(x[:50])):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (1 if row[f[node]] <= t[node] else 2)
            total += leaf[node - len(f)]
        assert abs(total - score) < 1e-12
