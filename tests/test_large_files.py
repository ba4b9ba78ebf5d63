"""Large export files: split whatever their size, read without a shuffle, written without holding an array, streamed by name."""

from __future__ import annotations

import gzip
import json
import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, play
from replaylab.plans import catalog, q_ingest
from replaylab.session import scratch_folder
from replaylab.sources import export_json as E
from replaylab.sources import large_export
from replaylab.sources import history_store as HS
from replaylab.streaming import pipelines as P

N = 30_000


def lines(path, n=N):
    """A file above the limit for whole reading: newline-delimited plays with a long name."""
    with open(path, "w") as f:
        for i in range(n):
            f.write(json.dumps({"ts": "2024-01-01T00:00:00Z", "username": f"u{i % 7}", "ms_played": i, "master_metadata_track_name": "x" * 300}) + "\n")
    return str(path)


def test_a_file_of_some_mb_is_split(spark, tmp_path):
    path = lines(tmp_path / "big.json")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        raw = E.read_export(spark, [path])
        held = [r.n for r in raw.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(held) == N and max(held) < N / 4
        assert raw.agg(F.sum("ms_played").cast("long")).first()[0] == N * (N - 1) // 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fragments_are_not_shuffled(spark, tmp_path):
    raw = E.read_export(spark, [lines(tmp_path / "big.json", 50)], max_whole_bytes=0)
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert raw.count() == 50


def test_arrays_are_written_play_by_play(spark, make_history, tmp_path):
    h = make_history([play("2024-01-01T00:00:00", "A", "T", ms=i) for i in range(23)]).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        E.write_export(h, str(tmp_path / "out"), rows_per_file=10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = [f.read_text() for f in sorted((tmp_path / "out").glob("*.txt"))]
    assert [len(json.loads(t)) for t in texts] == [10, 10, 3]
    assert not any("\n" in t for t in texts)
    assert [p["ms_played"] for t in texts for p in json.loads(t)] == list(range(23))
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["value"]) for x in (["{}"], [], ["{}", "{}"], ["{}"], [])]
    assert "".join(v for b in E._bracketed(2)(iter(batches)) for v in b.column(0).to_pylist()) == "[{},{}][{},{}]"


def test_streamed_files_are_read_by_name(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    lines(drop / "big.json")
    lines(drop / "a [1] {b}.json", 3)
    store, ckpt = P.scratch(spark, "t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        for _ in range(2):
            P.ingest_to_store(spark, str(drop), store, ckpt)
        assert P.file_stream(spark, str(drop)).columns == ["path"]  # no file's text goes through the stream
        assert HS.load_history(spark, store).count() == N + 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


PLAY = '{"ts":"2024-01-01T00:00:00Z","username":"u%d","master_metadata_track_name":"a, b: [c]","ms_played":%d,"skipped":null}'
TEXTS = {
    "lines": "\n".join(PLAY % (i, i) for i in range(40)) + "\n",
    "open end": "\n".join(PLAY % (i, i) for i in range(40)),
    "array": "﻿[" + ",\n".join(PLAY % (i, i) for i in range(40)) + "]",
    "unclosed": "[" + ",".join(PLAY % (i, i) for i in range(40)),
    "cut": "\n".join(PLAY % (i, i) for i in range(40))[:-1],
    "one brace more": "\n".join(PLAY % (i, i) for i in range(40)) + "}",
    "braces": "[" + ",".join((PLAY % (i, i)).replace("[c]", "{x} \\\"}") for i in range(40)) + "]\n",
    "not JSON": "\n".join((PLAY % (i, i)).replace("null", "nul" if i == 7 else "007" if i == 9 else "null") for i in range(40)),
}


@pytest.mark.parametrize("name", TEXTS)
def test_compressed_files_are_read_like_plain_ones(spark, tmp_path, name):
    text = TEXTS[name].encode()
    (tmp_path / "a.json").write_bytes(text)
    with gzip.open(tmp_path / "a.json.gz", "wb") as f:
        f.write(text)
    got = [sorted(map(str, E.read_parsed(spark, str(tmp_path / n), max_whole_bytes=0).drop("file_name").collect())) for n in ("a.json", "a.json.gz")]
    assert got[0] == got[1] and sum("problem=None" in r for r in got[0]) >= 38


def test_audio_files_may_be_compressed(spark, tmp_path):
    for kind, n in (("Audio", 3), ("Video", 5)):
        with gzip.open(tmp_path / f"Streaming_History_{kind}_0.json.gz", "wt") as f:
            f.write("".join(PLAY % (i, i) + "\n" for i in range(n)))
    assert E.read_export(spark, [str(tmp_path)], validate=False, glob=E.ANY_EXPORT, audio_only=True).count() == 3
    assert E.read_export(spark, [str(tmp_path)], validate=False, glob=E.ANY_EXPORT).count() == 8


def test_a_file_is_trimmed_once(spark, tmp_path):
    """The cases of a text mention it six times; each mention trimmed the whole file."""
    (tmp_path / "a.json").write_text("﻿ \n[" + PLAY % (1, 1) + "]\n ")
    parsed = E.read_parsed(spark, str(tmp_path / "a.json"))
    assert [r.ms_played for r in parsed.collect()] == ["1"]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("uFEFF") == 1


@pytest.mark.parametrize("query", ["a01_ndjson", "a01_export_json_roundtrip", "a01_large_array", "a16_new_files", "a17_audio_only"])
def test_exports_are_written_small(spark, monkeypatch, query):
    """Plays take 412 bytes each as plain JSON."""
    made = []
    monkeypatch.setattr(q_ingest, "_store_path", lambda spark, tag: made.append(scratch_folder(spark, tag)) or made[-1])
    catalog.QUERIES[query](spark, SF_SMALL).collect()
    held = sum(f.stat().st_size for p in made for f in Path(p.removeprefix("file:")).rglob("*") if f.name.endswith((".json", ".txt", ".gz")))
    plays = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count() + (0 if query.startswith("a01") else spark.read.parquet(f"{SF_SMALL}/events.parquet").count())
    assert 0 < held < 130 * plays


def test_what_needs_no_parsing_is_strict_json():
    flat = re.compile(large_export._FLAT)
    for good in (PLAY % (1, 1), '{ "a" : -1.5 , "b":true }', '{"":0}'):
        assert json.loads(good) and flat.search(good)
    for bad in ('{"a":01}', '{"a":1,}', '{"a" 1}', '{"a":nul}', '{"a":"x\ty"}', '{"a":"\\x"}', '{"a":{}}', '{"a":[1]}', '{"a":1}x', "{'a':1}", '{"a":+1}', '{"a":1.}', "{}"):
        assert not flat.search(bad)
