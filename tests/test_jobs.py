"""The precompute job writes every per-listener table; spot-check against single-listener runs."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from replaylab import api, jobs
from replaylab.sources import history_store as HS
from replaylab.sources.plays import plays


def test_precompute_dashboards(spark):
    base = tempfile.mkdtemp(prefix="jobs-")
    HS.append_history(plays(spark, SF_SMALL), f"{base}/store")
    names = jobs.precompute_dashboards(spark, f"{base}/store", f"{base}/out", limit=3)
    for n in names:
        assert spark.read.parquet(f"{base}/out/{n}").count() > 0, n
    # one listener's precomputed card equals the on-demand card
    h = HS.load_history(spark, f"{base}/store").drop("year")
    me = h.where(F.col("username") == "user3")
    card = spark.read.parquet(f"{base}/out/top_artists").where("username = 'user3' AND rank = 1").first()
    live = api.top_artist(me)
    assert (card.artist_name, card.total_streams) == (live["artist_name"], live["total_streams"])
    chart = spark.read.parquet(f"{base}/out/artist_chart").where("username = 'user3'")
    live_chart = api.artist_rank(me, limit=3)
    nested = sorted((r.rank, r.artist_name, list(r.monthly_ranks)) for r in chart.collect())
    assert nested == [(d["rank"], d["artist_name"], d["monthly_ranks"]) for d in live_chart["data"]]
    assert all(len(ranks) == live_chart["total_months"] for _, _, ranks in nested)


def test_shared_day_aggregate_equals_direct_operators(spark):
    from replaylab.operators import activity as A
    from replaylab.sources.plays import event_plays

    h = event_plays(spark, SF_SMALL)
    tables = jobs.dashboard_tables(h, limit=2)
    by = ("username",)
    for name, direct in (("streaks", A.longest_streak(h, by=by)), ("weekday", A.top_weekday(h, by=by))):
        got = sorted(tuple(r) for r in tables[name].select(*direct.columns).collect())
        assert got == sorted(tuple(r) for r in direct.collect()), name
