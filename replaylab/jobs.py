"""Batch job: precompute every listener's dashboard tables.

At scale the dashboard is served from precomputed tables, one job for all
listeners, instead of one query per request.  Every table is an operator run
with ``by=("username",)``: hash-partitioned on the listener, partial
aggregation first, map-side top-k, and the chart's top list checkpointed once.
Each table is written as Parquet; a failed or lost executor only re-runs its
tasks, and a re-run overwrites the same outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replaylab.functions import expr as X
from replaylab.operators import activity as A
from replaylab.operators import charts as C
from replaylab.operators import metrics as M
from replaylab.operators import skips as S
from replaylab.operators._common import materialize
from replaylab.sources import history_store as HS

BY = ("username",)


def dashboard_tables(h: DataFrame, limit: int = 8) -> dict[str, DataFrame]:
    """The per-listener tables (lazy; the chart checkpoints its top lists)."""
    # Plays without a listener are a group of their own (username NULL) in every table.
    # One (listener, day) aggregate, checkpointed, serves daily, streaks and weekday.
    daily = materialize(A.daily_counts(h, by=BY))
    # All breakdowns come from one scan.
    breakdowns = materialize(M.breakdown_cards(h, by=BY))
    return {
        "cards": M.overview_cards(h, by=BY),
        "total_time": M.total_time(h, by=BY),
        "top_artists": M.top_artist(h, n=10, by=BY),
        "top_albums": M.top_album(h, n=10, by=BY),
        "top_tracks": M.top_track(h, n=10, by=BY),
        "artist_chart": C.Chart(h, C.ARTIST, limit, by=BY).nested(),
        "track_chart": C.Chart(h, C.TRACK, limit, by=BY).nested(),
        "most_hated": S.most_hated(h, S.ARTIST, n=10, min_plays=20, by=BY),
        "daily": daily,
        "streaks": A.longest_of(A.streaks_from_days(daily, by=BY), by=BY),
        "weekday": A.top_weekday_of(A.weekday_from_days(daily, by=BY, ms_col="total_ms"), by=BY),
        "breakdowns": breakdowns,
        "platforms": breakdowns.where("card = 'platform'").select(
            *BY, F.col("value").alias("platform"), "streams", "total_ms", X.minutes("total_ms").alias("total_minutes"),
            "stream_share", "ms_share"),
    }


def precompute_dashboards(spark: SparkSession, store: str, out: str, limit: int = 8,
                          concurrent_jobs: int = 4) -> list[str]:
    """Read the history store, write every per-listener table under ``out``; returns the table names.

    The tables are independent Spark jobs; up to ``concurrent_jobs`` are
    submitted at once (Spark runs jobs from several driver threads
    concurrently), so small stages of one table overlap with another's
    instead of leaving executors idle.  Each scan reads only its own columns.
    """
    from concurrent.futures import ThreadPoolExecutor

    h = HS.load_history(spark, store)
    tables = dashboard_tables(h, limit)
    root = out.rstrip("/")

    def write(item: tuple[str, DataFrame]) -> str:
        name, df = item
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return name

    with ThreadPoolExecutor(max_workers=max(1, concurrent_jobs)) as pool:
        return list(pool.map(write, tables.items()))
