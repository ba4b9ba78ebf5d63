"""JSON export ingestion, lenient casts, privacy, the history store (FIXTURES §1, §5 casts)."""

from __future__ import annotations

import datetime as dt
import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from replaylab.operators import cleanup as CL
from replaylab.schema import HISTORY_COLUMNS
from replaylab.sources import export_json as X
from replaylab.sources import history_store as HS

REC = {
    "ts": "2024-01-02T03:04:05Z", "username": "me", "platform": "ios", "ms_played": 1234,
    "conn_country": "SE", "ip_addr": "1.2.3.4", "ip_addr_decrypted": "1.2.3.4",
    "user_agent_decrypted": "ua", "master_metadata_track_name": "T",
    "master_metadata_album_artist_name": "A", "master_metadata_album_album_name": "Al",
    "spotify_track_uri": "spotify:track:1", "episode_name": None, "episode_show_name": None,
    "spotify_episode_uri": None, "reason_start": "trackdone", "reason_end": "endplay",
    "shuffle": True, "skipped": None, "offline": False, "offline_timestamp": 1704164645,
    "incognito_mode": False,
}


def write(folder: Path, name: str, records, pretty: bool = False) -> str:
    p = folder / name
    p.write_text(json.dumps(records, indent=2 if pretty else None))
    return str(p)


@pytest.fixture()
def folder():
    return Path(tempfile.mkdtemp(prefix="exports-"))


def test_one_line_and_pretty_arrays_merge_by_name(spark, folder):
    a = write(folder, "Streaming_History_Audio_2025_1.json", [REC, REC])
    b_rec = {k: v for k, v in REC.items() if not k.startswith("master_metadata")}
    b = write(folder, "Streaming_History_Audio_2022-2025_0.json", [b_rec], pretty=True)
    h = X.ingest(spark, [a, b])
    assert h.columns == list(HISTORY_COLUMNS)
    rows = h.collect()
    assert len(rows) == 3
    assert sorted((r.track_name or "-") for r in rows) == ["-", "T", "T"]
    r = [x for x in rows if x.track_name == "T"][0]
    assert r.ts == dt.datetime(2024, 1, 2, 3, 4, 5) and r.ms_played == 1234 and r.shuffle is True
    assert r.skipped is None and r.offline_timestamp == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_private_keys_never_read(spark, folder):
    a = write(folder, "x.json", [REC])
    raw = X.read_export(spark, [a])
    assert not {"ip_addr", "ip_addr_decrypted", "user_agent_decrypted"} & set(raw.columns)
    assert "ip_addr" not in raw._jdf.queryExecution().executedPlan().toString()


def test_lenient_casts(spark, folder):
    variants = [dict(REC, ms_played="abc"), dict(REC, ms_played=1234.5), dict(REC, ms_played=1235.5),
                dict(REC, ms_played=None), dict(REC, skipped="yes"), dict(REC, shuffle="maybe"),
                dict(REC, ts="garbage"), dict(REC, ts="2024-01-02T03:04:05+02:00"),
                dict(REC, offline_timestamp=1704164645000)]
    p = write(folder, "casts.json", variants)
    rows = X.ingest(spark, [p]).collect()
    assert [r.ms_played for r in rows[:4]] == [None, 1234, 1236, None]   # half-even on decimals
    assert rows[4].skipped is True and rows[5].shuffle is None
    assert rows[6].ts is None and rows[7].ts == dt.datetime(2024, 1, 2, 1, 4, 5)
    assert rows[8].offline_timestamp == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_missing_key_everywhere_and_empty_array(spark, folder):
    rec = {k: v for k, v in REC.items() if k != "skipped"}
    p = write(folder, "a.json", [rec])
    e = write(folder, "empty.json", [])
    rows = X.ingest(spark, [p, e]).collect()
    assert len(rows) == 1 and rows[0].skipped is None
    pres = {r.key: r.present for r in X.present_columns(X.read_export(spark, [p])).collect()}
    assert pres["skipped"] is False and pres["ts"] is True


def test_validation_and_audio_only(spark, folder):
    with pytest.raises(X.ExportError):
        X.validate_paths([])
    with pytest.raises(X.ExportError):
        X.validate_paths([str(folder / "notes.txt")])
    with pytest.raises(X.ExportError):
        X.validate_paths([str(folder / "upper.JSON")])
    a = write(folder, "Streaming_History_Audio_2024_0.json", [REC])
    v = write(folder, "Streaming_History_Video_2024_0.json", [REC, REC])
    assert X.ingest(spark, [a, v]).count() == 3
    assert X.ingest(spark, [a, v], audio_only=True).count() == 1


def test_store_append_twice_doubles_and_report(spark, folder):
    p = write(folder, "Streaming_History_Audio_2025_1.json", [REC, dict(REC, ts=None)])
    store = str(folder / "store")
    with pytest.raises(HS.HistoryNotFound):
        HS.load_history(spark, store)
    r1 = HS.upload(spark, [p], store).collect()[0]
    r2 = HS.upload(spark, [p, p], store).collect()[0]
    assert (r1.files_processed, r1.total_rows) == (1, 2)
    assert (r2.files_processed, r2.total_rows) == (2, 6)   # no dedup on upload (same file twice)
    h = HS.load_history(spark, store)
    assert h.where(F.col("year") == 2024).count() == 3 and h.where(F.col("ts").isNull()).count() == 3
    # year pruning reaches the scan
    plan = h.where(F.col("year") == 2024)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_new_files_anti_join(spark, folder):
    write(folder, "a.json", [REC])
    write(folder, "b.json", [REC, REC])
    listing = X.file_listing(spark, str(folder))
    manifest = listing.where(F.col("file_name") == "a.json")
    assert [r.file_name for r in X.new_files(listing, manifest).collect()] == ["b.json"]


def test_cleanup_helpers(spark, folder):
    p = write(folder, "a.json", [REC])
    raw = X.read_export(spark, [p])
    kept = CL.drop_empty_columns(raw).columns
    assert "episode_name" not in kept and "ts" in kept
    prof = {r.column_name: (r.dtype, r.non_null, r.total_rows) for r in CL.profile(X.normalize(raw)).collect()}
    assert prof["ms_played"] == ("bigint", 1, 1) and prof["episode_uri"] == ("string", 0, 1)
    m = CL.with_minutes(X.normalize(raw)).collect()[0]
    assert m.minutes_played == pytest.approx(1234 / 60000)
    both = CL.concat_parts(raw, raw.drop("platform"))
    assert both.count() == 2 and "platform" in both.columns


def test_export_sink_files_are_bounded_arrays(spark, folder):
    from conftest import SF_SMALL
    from replaylab.sources.plays import plays

    h = plays(spark, SF_SMALL)
    out = str(folder / "export")
    X.write_export(h, out, rows_per_file=1000)
    files = sorted(Path(out).glob("*.txt"))
    sizes = []
    for f in files:
        doc = json.loads(f.read_text())
        assert isinstance(doc, list) and 0 < len(doc) <= 1000
        assert not {"ip_addr", "ip_addr_decrypted", "user_agent_decrypted"} & set(doc[0])
        sizes.append(len(doc))
    assert sum(sizes) == h.count()
    back = X.normalize(X.read_export(spark, [out], validate=False, glob="*.txt"))
    assert back.count() == h.count()
    assert back.agg(F.sum("ms_played")).first()[0] == h.agg(F.sum("ms_played")).first()[0]


def test_corrupt_file_fails_the_upload(spark, folder):
    good = write(folder, "good.json", [REC])
    bad = folder / "bad.json"
    bad.write_text("{not json")
    with pytest.raises(Exception, match="Not a JSON array of plays: bad.json"):
        X.ingest(spark, [good, str(bad)]).collect()
    lenient = X.normalize(X.read_export(spark, [good, str(bad)], strict=False)).count()
    assert lenient == 1


def test_store_is_clustered_for_one_listener(spark, folder):
    import pyarrow.parquet as pq

    from conftest import SF_SMALL
    from replaylab.sources.plays import plays

    store = str(folder / "clustered")
    HS.append_history(plays(spark, SF_SMALL), store)
    h = HS.load_history(spark, store)
    one = h.where((F.col("username") == "user7") & (F.col("year") == 1996))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)  # show the filters whole
    try:
        plan = one._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    folders = plan[plan.index("PartitionFilters: ["):].split("]")[0]
    assert "EqualTo(username,user7)" in plan and "isnotnull(year" in folders and "= 1996" in folders
    for f in Path(store).rglob("*.parquet"):
        users = pq.read_table(f, columns=["username"]).column("username").to_pylist()
        assert users == sorted(users)      # clustered: row-group min/max on username prune
