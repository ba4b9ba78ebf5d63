"""The pipeline's stages against brute force, each on its own input."""

import duckdb
import numpy as np
import pytest
from llm.test_line_dedup import brute as brute_lines
from llm.test_packing import check_places
from llm.test_simhash import brute_components, brute_fingerprint

import __spark_entry__ as E
import corpus_pipeline
from replaylab.llm import quality
from replaylab.llm._common import stored, table


@pytest.fixture(scope="module")
def steps(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, out = table(spark, sf_dir, "documents"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "t")
        out.append(docs)
    return out


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "best-fit packing"]
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_quality_stage(spark, steps):
    docs, labels = steps[0], table(spark, "/root/testdata/sf0.01", "labels")
    verdicts = quality.score(docs, quality.train(docs, labels))
    want = sorted(r.doc_id for r in verdicts.where("kept").collect())
    assert [d for d, _ in rows_of(steps[1])] == want
    truth = {r.doc_id: r.quality for r in labels.collect()}
    kept = set(want)
    good = [d in kept for d, q in truth.items() if q == 1]
    assert np.mean(good) > 0.95


def test_line_stage(steps):
    want = sorted((d, t) for d, _, _, t in brute_lines(rows_of(steps[1])))
    assert rows_of(steps[2]) == want
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_near_copy_stage(steps):
    docs = rows_of(steps[2])
    roots = brute_components([d for d, _ in docs], [brute_fingerprint(t) for _, t in docs])
    assert rows_of(steps[3]) == [row for row, root in zip(docs, roots) if row[0] == root]


def test_packing_stage(steps):
    rows = steps[4].collect()
    assert {r.doc_id for r in rows} == {d for d, _ in rows_of(steps[3])}
    assert check_places(rows, 1024) <= 1.01 * (sum(r.length for r in rows) / 1024) + 2


def test_run_is_registered(spark, steps):
    df = E.queries()["pipeline"](spark, "/root/testdata/sf0.01")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(map(tuple, steps[4].select(cols).collect()))


def test_entry_has_all(sf_small):
    names = [n for n in E.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    for name, sql in E.oracle_sql().items():
        if name.startswith("op"):
            con.execute(sql).fetchall()


def test_odd_and_empty_tables_pass_all_stages(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "some words here " * 30), (None, "some words here " * 30), (3, "x"), (3, "other words there " * 30)])
    for table_ in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            table_ = stored(stage(spark, table_, "/root/testdata/sf0.001"), "t")
    assert table_.count() == 0
