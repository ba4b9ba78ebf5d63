"""Listening sessions and streaks that follow uploads in any order (S04, F04): no watermark, no listener's plays in one task.

Every upload leaves its own *runs* beside the store, published by marker like the plays: per (listener, UTC day), the stretches in
which each play starts less than the gap after another one, as intervals ``[start, reach)`` in microseconds; ``reach`` is the gap after
the last play.  Runs of any uploads that overlap belong to one session, whatever order they came in, so readers merge intervals and
never reread plays: first inside (listener, day), which spreads a hot listener over many tasks, then across days, where a listener
has at most time span / gap runs left.  A repeated upload replaces its runs; days with any run are a listener's active days.

Undated plays have no run.  A null listener is a listener.  An empty folder gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replaylab.functions import expr as X
from replaylab.operators import activity as A
from replaylab.operators._common import By, by_list
from replaylab.sources import history_store as HS
from replaylab.sources import published

GAP_MINUTES = 30
SCHEMA = T.StructType([T.StructField("username", T.StringType()), T.StructField("day", T.DateType()), T.StructField("start", T.LongType()),
                       T.StructField("reach", T.LongType()), T.StructField("plays", T.LongType()), T.StructField("total_ms", T.LongType())])


def merge(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping ``[start, reach)`` of the same ``keys`` as one row, with sums of plays and ms and the first ``day``."""
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("start")
    before = F.max("reach").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("start") >= before, F.lit(True)).cast("int")
    # A range frame: runs of equal start overlap, and get the same number whichever comes first.
    number = F.sum("__apart").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    first_day = [] if "day" in keys else [F.min("day").alias("day")]
    return runs.withColumn("__apart", apart).withColumn("__number", number).groupBy(*keys, "__number").agg(
        *first_day, F.min("start").alias("start"), F.max("reach").alias("reach"),
        F.sum("plays").cast("bigint").alias("plays"), F.sum("total_ms").cast("bigint").alias("total_ms")).drop("__number")


def day_runs(h: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """The runs of ``h`` by (listener, UTC day).  Plays of the same instant are added up map-side first."""
    t = F.unix_micros("ts")
    instants = h.where(F.col("ts").isNotNull()).groupBy("username", t.alias("start")).agg(
        F.count(F.lit(1)).alias("plays"), F.coalesce(F.sum("ms_played"), F.lit(0)).cast("bigint").alias("total_ms"))
    intervals = instants.withColumns({"day": X.day(F.timestamp_micros("start")), "reach": F.col("start") + F.lit(gap_minutes * 60_000_000)})
    return merge(intervals, ["username", "day"]).select(*SCHEMA.names)


def _folder(path: str, gap_minutes: int) -> str:
    return f"{path.rstrip('/')}/gap-{gap_minutes}"


def publish_runs(spark: SparkSession, store: str, upload: str, path: str, gap_minutes: int = GAP_MINUTES) -> None:
    """Write the runs of a stored upload; only its plays are read."""
    rows = day_runs(HS.load_history(spark, store, only_uploads=[upload]), gap_minutes)
    published.publish(rows, _folder(path, gap_minutes), upload, column="upload")


def _runs(spark: SparkSession, path: str, gap_minutes: int) -> DataFrame:
    found = published.read(spark, _folder(path, gap_minutes), SCHEMA, column="upload")
    return spark.createDataFrame([], SCHEMA) if found is None else found.drop("upload")


def sessions(spark: SparkSession, path: str, gap_minutes: int = GAP_MINUTES, by: By = ("username",), closed_by: str | None = None) -> DataFrame:
    """S04 over all uploads: (by, session_start, session_end, plays, total_ms), as ``listening_sessions`` gives them.

    ``closed_by`` leaves out sessions that end after that instant, which a later play might still prolong.
    """
    by = by_list(by)
    whole = merge(merge(_runs(spark, path, gap_minutes), [*by, "day"]), by)
    if closed_by is not None:
        whole = whole.where(F.col("reach") <= F.unix_micros(X.instant(closed_by)))
    return whole.select(*by, F.timestamp_micros("start").alias("session_start"), F.timestamp_micros("reach").alias("session_end"), "plays", "total_ms")


def active_days(spark: SparkSession, path: str, gap_minutes: int = GAP_MINUTES, by: By = ()) -> DataFrame:
    """F02 by rows: the distinct (by, day) that hold a run."""
    return _runs(spark, path, gap_minutes).select(*by_list(by), "day").distinct()


def streaks(spark: SparkSession, path: str, gap_minutes: int = GAP_MINUTES, by: By = ()) -> DataFrame:
    """F04 over all uploads, from the runs' days: a day that arrives late joins the streaks on both its sides."""
    return A.streaks_from_days(active_days(spark, path, gap_minutes, by), by)


def compact(spark: SparkSession, path: str, gap_minutes: int = GAP_MINUTES) -> int:
    """Rewrite all live uploads' runs into few files; returns the number of uploads."""
    return published.compact(spark, _folder(path, gap_minutes), SCHEMA, column="upload", cluster_by=("username", "start"))
