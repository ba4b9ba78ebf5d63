"""Operator 4: SQL oracle and canonical forms."""

import re
import textwrap

import duckdb
import pytest

from replaylab.llm import licenses, queries
from replaylab.llm.license_texts import LICENSES, _long_texts

LONG = _long_texts()


def test_query_matches_sql(spark, sf_mid):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_mid}/documents.parquet'")
    want = sorted(con.execute(queries.ORACLE["op4_licenses"]).fetchall())
    df = queries.op4_licenses(spark, sf_mid)
    assert sorted(tuple(r) for r in df.select("doc_id", "canonical_digest", "license_id").collect()) == want
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def variants(text):
    yield text
    yield text.upper()
    yield "Copyright (c) 1999-2024 Jane Doe <jane@example.org>\nAll rights reserved.\n\n" + text
    yield "# Copyright 2020 The Authors\n// (c) 2021, 2022 Someone\n© Else\n" + textwrap.fill(text, 50)
    yield text.replace('"', "“").replace("license", "licence").replace("License", "Licence").replace("sublicense", "sub-license").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")
    yield "\n".join(" * " + x for x in textwrap.wrap(text, 60))


@pytest.mark.parametrize("name", sorted({i for i, _ in LICENSES} - {i for i, _ in LONG}))
def test_variants_of_a_license(make_docs, name):
    docs = [(n, v) for n, v in enumerate(v for i, t in LICENSES if i == name for v in variants(t))]
    assert {r.license_id for r in licenses.scan(make_docs(docs)).collect()} == {name}


def wrapped(text, width):
    """Each paragraph filled anew; those with a copyright line, which is a line by its meaning, keep their lines."""
    return "\n\n".join(p if re.search(licenses.COPYRIGHT_LINE, p.lower()) else textwrap.fill(p, width) for p in text.split("\n\n"))


def test_long_licenses_in_other_layouts(make_docs):
    want, docs = {}, []
    for name, text in LONG:
        for v in (text, text.upper(), "\n".join("# " + line for line in text.splitlines()), wrapped(text, 100), text.replace("license", "licence") + "\n\n"):
            want[len(docs)] = name
            docs.append((len(docs), v))
    middle = [(len(docs) + n, text[:len(text) // 2] + " not " + text[len(text) // 2:]) for n, (_, text) in enumerate(LONG)]
    got = {r.doc_id: r.license_id for r in licenses.scan(make_docs(docs + middle)).collect()}
    assert {i for i, _ in LONG} >= {"Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"}
    assert {n: i for n, i in got.items() if i} == want


def test_other_texts_are_no_license(make_docs):
    mit = next(t for i, t in LICENSES if i == "MIT")
    docs = [(1, mit + " but not on Sundays"), (2, mit.replace("free of charge", "for a fee")), (3, None), (4, ""), (5, " .,; "), (None, mit), (6, mit), (6, mit),
            (7, "Released under the MIT License."), (8, "x" * 500_000), (9, mit * 2)]
    rows = licenses.scan(make_docs(docs)).collect()
    assert len(rows) == len(docs)
    assert sorted((r.doc_id or 0) for r in rows if r.license_id) == [0, 6, 6]
    assert {r.license_id for r in rows if r.license_id} == {"MIT"}
    assert len({r.canonical_digest for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert licenses.scan(make_docs(docs).limit(0)).count() == 0


def test_clauses_are_no_copyright_lines(spark):
    keep = ["(c) You must retain all notices", "copyright notice and this permission", "AUTHORS OR\nCOPYRIGHT HOLDERS BE LIABLE"]
    gone = ["Copyright (c) 2020 X", "copyright 2020 x", "  Copyright <YEAR> <HOLDER>", "(c) 2020 X", "© X", "All rights reserved.", "Copyright © Foo", "Copyright by Foo"]
    df = spark.createDataFrame([(t,) for t in keep + gone], "text string").select("text", licenses.canonical(licenses.F.col("text")).alias("form"))
    assert {r.text for r in df.collect() if r.form} == set(keep)


def test_own_table_of_licenses(spark, make_docs):
    known = spark.createDataFrame([("b", "Some own terms!"), ("a", "some OWN terms"), ("empty", "...")], "license_id string, text string")
    assert [r.license_id for r in licenses.scan(make_docs([(1, "Some, own: terms."), (2, "")]), known).orderBy("doc_id").collect()] == ["a", None]
