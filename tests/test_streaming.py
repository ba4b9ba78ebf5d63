"""Structured Streaming forms: exactly-once ingest, dedup, windows, sessions."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from replaylab.streaming import pipelines as P


def _rec(ts, track="T", user="me", ms=1000):
    return {"ts": ts, "username": user, "ms_played": ms, "master_metadata_track_name": track,
            "master_metadata_album_artist_name": "A", "spotify_track_uri": f"spotify:track:{track}"}


def test_ingest_stream_exactly_once(spark):
    d = Path(tempfile.mkdtemp(prefix="drop-"))
    (d / "Streaming_History_Audio_2024_0.json").write_text(json.dumps(
        [_rec("2024-01-01T10:00:00Z"), _rec("2024-01-01T10:05:00Z"), _rec("2023-05-01T00:00:00Z")], indent=2))
    sink, ckpt = P.scratch(spark, "test-s01")
    P.run_available_now(P.ingest_stream(spark, str(d)), sink, ckpt, partition_by=("year",))
    P.run_available_now(P.ingest_stream(spark, str(d)), sink, ckpt, partition_by=("year",))
    assert spark.read.parquet(sink).count() == 3          # second run adds nothing
    (d / "Streaming_History_Audio_2024_1.json").write_text(json.dumps([_rec("2024-02-01T00:00:00Z")]))
    (d / "notes.txt").write_text("not an export")
    P.run_available_now(P.ingest_stream(spark, str(d)), sink, ckpt, partition_by=("year",))
    out = spark.read.parquet(sink)
    assert out.count() == 4 and set(r.year for r in out.select("year").distinct().collect()) == {2023, 2024}


def test_dedup_windows_sessions(spark):
    d = Path(tempfile.mkdtemp(prefix="drop-"))
    recs = [_rec("2024-01-01T10:00:00Z"), _rec("2024-01-01T10:00:00Z"),   # a re-uploaded copy
            _rec("2024-01-01T10:20:00Z"), _rec("2024-01-01T12:00:00Z"),
            _rec("2024-01-03T09:00:00Z")]
    (d / "a.json").write_text(json.dumps(recs))
    h = P.ingest_stream(spark, str(d))

    sink, ckpt = P.scratch(spark, "test-s02")
    P.run_available_now(P.dedup_stream(h, "1 day"), sink, ckpt)
    assert spark.read.parquet(sink).count() == 4

    sink, ckpt = P.scratch(spark, "test-s03")
    P.run_available_now(P.daily_windows(h, "1 hour"), sink, ckpt)
    days = {r.day.isoformat(): r.streams for r in spark.read.parquet(sink).collect()}
    assert days == {"2024-01-01": 4}        # Jan 3 is still open at the final watermark

    sink, ckpt = P.scratch(spark, "test-s04")
    P.run_available_now(P.sessions(h, "30 minutes", "1 hour"), sink, ckpt)
    s = sorted((r.session_start.isoformat(), r.plays) for r in spark.read.parquet(sink).collect())
    assert s == [("2024-01-01T10:00:00", 3), ("2024-01-01T12:00:00", 1)]


def test_late_rows_beyond_watermark_are_dropped(spark):
    d = Path(tempfile.mkdtemp(prefix="drop-"))
    sink, ckpt = P.scratch(spark, "test-late")
    (d / "a.json").write_text(json.dumps([_rec("2024-01-01T10:00:00Z"), _rec("2024-01-03T10:00:00Z")]))
    P.run_available_now(P.daily_windows(P.ingest_stream(spark, str(d)), "1 hour"), sink, ckpt)
    # watermark is now 2024-01-03 09:00: Jan 1 was emitted; a new Jan 1 play is late and dropped,
    # a Jan 2 play is late too (its window ended before the watermark), Jan 4 advances the watermark.
    (d / "b.json").write_text(json.dumps([_rec("2024-01-01T23:00:00Z"), _rec("2024-01-02T12:00:00Z"),
                                          _rec("2024-01-04T12:00:00Z")]))
    P.run_available_now(P.daily_windows(P.ingest_stream(spark, str(d)), "1 hour"), sink, ckpt)
    days = {r.day.isoformat(): r.streams for r in spark.read.parquet(sink).collect()}
    assert days == {"2024-01-01": 1, "2024-01-03": 1}
