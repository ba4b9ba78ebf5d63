"""Daily totals that late plays correct (S03, D01): signed to nothing, dropped by no watermark.

Every upload of a stream leaves its own (listener, UTC day) shares beside the store, published by marker like the plays.  Totals are
sums over live uploads, so a repeated batch replaces its share, and a play that arrives years late adds to its day.  Days that are
older than the newest day that other uploads held when the share was written are marked as corrections: what a watermark would have dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replaylab.operators import activity as A
from replaylab.operators._common import By, by_list
from replaylab.sources import history_store as HS
from replaylab.sources import published

SCHEMA = T.StructType([T.StructField("username", T.StringType()), T.StructField("day", T.DateType()), T.StructField("streams", T.LongType()),
                       T.StructField("total_ms", T.LongType()), T.StructField("correction", T.BooleanType())])


def _shares(spark: SparkSession, path: str) -> DataFrame:
    found = published.read(spark, path, SCHEMA, column="upload")
    return spark.createDataFrame([], T.StructType([*SCHEMA.fields, T.StructField("upload", T.StringType())])) if found is None else found


def publish_days(spark: SparkSession, store: str, upload: str, path: str) -> None:
    """Write the (listener, day) share of a stored upload; undated plays have no day and no share."""
    newest = _shares(spark, path).where(F.col("upload") != upload).agg(F.max("day").alias("d")).first().d
    rows = A.daily_counts(HS.load_history(spark, store, only_uploads=[upload]), by=("username",))
    late = F.lit(False) if newest is None else F.col("day") < F.lit(newest)
    published.publish(rows.select("username", "day", "streams", "total_ms", late.alias("correction")), path, upload, column="upload")


def day_totals(spark: SparkSession, path: str, by: By = ()) -> DataFrame:
    """D01 from the shares: (by, day, streams, total_ms); an empty folder gives no rows."""
    return _shares(spark, path).groupBy(*by_list(by), "day").agg(
        F.sum("streams").cast("bigint").alias("streams"), F.sum("total_ms").cast("bigint").alias("total_ms"))


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """The late shares: (upload, username, day, streams, total_ms)."""
    return _shares(spark, path).where("correction").select("upload", "username", "day", "streams", "total_ms")
