"""The reference's own end-to-end checks, run against the service-shaped payloads.

Export files are derived from the driver tables (plays written in the export
format), uploaded into a fresh store, then every card and chart is checked as
the reference's suite does: row counts, non-null names, positive totals, and
the chart shape (months = total_months, first rank 1, one rank per month).
"""

from __future__ import annotations

import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from replaylab import api
from replaylab.sources import export_json as X
from replaylab.sources import history_store as HS
from replaylab.sources.plays import plays


@pytest.fixture(scope="module")
def uploaded(spark):
    base = Path(tempfile.mkdtemp(prefix="service-"))
    h = plays(spark, SF_SMALL)
    early = h.where(F.col("ts") < F.lit("1996-01-01").cast("timestamp"))
    late = h.where(F.col("ts") >= F.lit("1996-01-01").cast("timestamp"))
    files = []
    for name, part in (("Streaming_History_Audio_2025_1", early), ("Streaming_History_Audio_2022-2025_0", late)):
        tmp = str(base / name)
        X.write_export(part.coalesce(1), tmp, rows_per_file=10**9)
        [txt] = list(Path(tmp).glob("*.txt"))
        target = base / f"{name}.json"
        target.write_text(txt.read_text())
        files.append(str(target))
    store = str(base / "store")
    return files, store, early.count(), h.count()


def test_upload_and_core_query(spark, uploaded):
    files, store, n_early, _ = uploaded
    r = api.upload(spark, files[:1], store + "-one")
    assert r == {"status": "ok", "files_processed": 1, "total_rows": n_early}
    h = HS.load_history(spark, store + "-one")
    top = api.top_artist(h)
    assert top["artist_name"] is not None


def test_multi_file_upload_and_cards(spark, uploaded):
    files, store, _, n_all = uploaded
    r = api.upload(spark, files, store)
    assert (r["files_processed"], r["total_rows"]) == (2, n_all)
    h = HS.load_history(spark, store)
    t = api.total_time(h)
    assert t["status"] == "ok" and t["total_minutes"] > 0
    a, al, tr = api.top_artist(h), api.top_album(h), api.top_track(h)
    assert a["artist_name"] and a["total_streams"] > 0 and a["total_minutes"] > 0
    assert al["album_name"] and al["artist_name"] and al["total_streams"] > 0
    assert tr["track_name"] and tr["artist_name"] and tr["total_minutes"] > 0


@pytest.mark.parametrize("kind", ["artist", "track"])
def test_rank_charts(spark, uploaded, kind):
    files, store, _, _ = uploaded
    path = store + f"-{kind}"
    api.upload(spark, files, path)
    h = HS.load_history(spark, path)
    res = api.artist_rank(h, limit=5) if kind == "artist" else api.track_rank(h, limit=5)
    assert res["status"] == "ok"
    assert len(res["months"]) == res["total_months"] > 0
    assert len(res["data"]) >= 5
    assert res["data"][0]["rank"] == 1
    for item in res["data"]:
        assert len(item["monthly_ranks"]) == res["total_months"]


def test_empty_store_cards(spark, make_history):
    h = make_history([])
    assert api.top_artist(h) == {"status": "ok", "artist_name": None, "total_streams": 0,
                                 "total_minutes": 0.0}
    assert api.artist_rank(h)["total_months"] == 0
