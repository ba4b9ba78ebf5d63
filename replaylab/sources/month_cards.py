"""Overview cards of any range of months without reading plays.

Every upload leaves one row per (listener, UTC month), published by marker: plays, ms, the month's active days as the bits of an int, and a
HyperLogLog sketch of its songs.  All four merge across uploads, months and listeners, so a range is answered from these rows:
sums, and active days by OR of bits, are exact.  Unique songs are an estimate: exact but for rare collisions up to about 1,500
songs (the sketch still lists them), and of a standard error below 1 % beyond (``LG_K``).

A replaced upload takes its rows with it.  Undated plays belong to no month: they count only where no bound is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replaylab.functions import expr as X
from replaylab.operators._common import By, by_list
from replaylab.sources import published

LG_K = 14
SCHEMA = T.StructType([T.StructField("username", T.StringType()), T.StructField("month", T.DateType()), T.StructField("streams", T.LongType()),
                       T.StructField("total_ms", T.LongType()), T.StructField("days", T.IntegerType()), T.StructField("songs", T.BinaryType())])


def month_rows(h: DataFrame) -> DataFrame:
    """(username, month, streams, total_ms, days, songs) of the plays of ``h``, in one scan."""
    day = X.day("ts")
    bit = F.call_function("shiftleft", F.lit(1), F.dayofmonth(day) - 1)
    return h.groupBy("username", F.trunc(day, "month").alias("month")).agg(
        F.count(F.lit(1)).alias("streams"), F.coalesce(F.sum("ms_played"), F.lit(0)).cast("bigint").alias("total_ms"),
        F.coalesce(F.bit_or(bit), F.lit(0)).cast("int").alias("days"), F.hll_sketch_agg("track_uri", F.lit(LG_K)).alias("songs"))


def commit(h: DataFrame, path: str, upload: str) -> None:
    """Publish the rows of one upload's plays; the same upload again replaces them."""
    published.publish(month_rows(h), path, upload, column="upload")


def cards(spark: SparkSession, path: str, by: By = (), first: str | None = None, last: str | None = None) -> DataFrame:
    """(by, streams, total_ms, active_days, unique_songs) of the months ``first`` to ``last`` (texts ``YYYY-MM``, both included)."""
    by, rows = by_list(by), published.read(spark, path, SCHEMA, column="upload")
    if rows is None:
        rows = spark.createDataFrame([], SCHEMA)
    if first is not None:
        rows = rows.where(F.col("month") >= F.lit(f"{first}-01").cast("date"))
    if last is not None:
        rows = rows.where(F.col("month") <= F.lit(f"{last}-01").cast("date"))
    # A day counts once whichever uploads hold it, so bits are united by month before they are counted.
    months = rows.groupBy(*by, "month").agg(
        F.sum("streams").alias("s"), F.sum("total_ms").alias("ms"), F.bit_or("days").alias("d"), F.hll_union_agg("songs").alias("u"))
    return months.groupBy(*by).agg(
        F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("streams"), F.coalesce(F.sum("ms"), F.lit(0)).cast("bigint").alias("total_ms"),
        F.coalesce(F.sum(F.bit_count("d")), F.lit(0)).cast("bigint").alias("active_days"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("u")), F.lit(0)).cast("bigint").alias("unique_songs"))


def compact(spark: SparkSession, path: str) -> int:
    """Rewrite all live uploads' rows into few files; returns the number of uploads."""
    return published.compact(spark, path, SCHEMA, column="upload", cluster_by=("username", "month"))
