"""What a store holds already, by listener: the keys that cross-export de-duplication (S02, F14) looks up instead of the history.

    <store>/_keys/attempt=<random>/bucket=<n>/    (username, ts, item), published by marker, one unit per upload

``bucket`` is a hash of the listener, so a drop of a few listeners opens their buckets' files only; within them Parquet's bloom
filters on ``username`` and the time range of the drop skip row groups.  One upload may enter a store in other ways (``api.upload``);
:func:`index_uploads` reads each such upload once, and again if it was written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replaylab.operators._common import materialize, null_safe_join
from replaylab.operators.metrics import dedup_key
from replaylab.schema import HISTORY
from replaylab.sources import history_store as HS
from replaylab.sources import published

BUCKETS = 256
KEY = ("username", "ts", "item")
SCHEMA = T.StructType([T.StructField("username", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("item", T.StringType())])
FOLDER = T.StructType([T.StructField("bucket", T.IntegerType())])
BLOOM = {"parquet.bloom.filter.enabled#username": "true"}


def folder(store: str) -> str:
    return f"{store.rstrip('/')}/_keys"


def _bucket() -> Column:
    return F.pmod(F.xxhash64("username"), F.lit(BUCKETS)).cast("int")


def index_uploads(spark: SparkSession, store: str, without: str | None = None) -> int:
    """Index, in one job, the live uploads of ``store`` that have no keys yet or were written again since; returns how many they were.

    A marker's sequence tells: an upload's keys are published after its plays, and compaction keeps the sequence of what it copies.
    """
    written, indexed = published.marks(spark, store), published.marks(spark, folder(store))
    if written is None:
        return 0
    missing = published.live(written).select("unit", "seq")
    if indexed is not None:
        known = published.live(indexed).select(F.col("unit").alias("u"), F.col("seq").alias("s"))
        missing = missing.join(known, (missing.unit == known.u) & (missing.seq <= known.s), "left_anti")
    units = materialize(missing.where(F.col("unit") != F.lit(without or "")).select("unit"))
    n = units.count()
    if n:
        plays = published.read(spark, store, HISTORY, HS.YEAR, "upload", written)
        plays = plays.join(units.withColumnRenamed("unit", "upload"), "upload", "left_semi")
        rows = plays.select("upload", "username", "ts", dedup_key().alias("item")).distinct().withColumn("bucket", _bucket())
        rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *KEY)
        published.publish_units(rows, folder(store), units, ("bucket",), BLOOM)
    return n


def held_keys(spark: SparkSession, store: str, new: DataFrame, without_upload: str | None = None) -> DataFrame | None:
    """The stored keys of the listeners' buckets and the time range of ``new`` (username, ts, item), or None if there are none."""
    found = published.read(spark, folder(store), SCHEMA, FOLDER, "upload")
    if found is None:
        return None
    # At most BUCKETS numbers and two instants.
    wanted = new.agg(F.collect_set(_bucket()).alias("buckets"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    found = found.where(F.col("bucket").isin(wanted.buckets))
    within = F.col("ts").isNull()
    if wanted.lo is not None:
        within = within | F.col("ts").between(F.lit(wanted.lo), F.lit(wanted.hi))
    if without_upload is not None:
        found = found.where(F.col("upload") != without_upload)
    return found.where(within).select(*KEY)


def new_plays(h: DataFrame, held: DataFrame | None) -> DataFrame:
    """The rows of ``h`` whose key is not among ``held``."""
    if held is None:
        return h
    keyed = h.withColumn("item", dedup_key())
    return null_safe_join(keyed, held, list(KEY), how="left_anti").drop("item")
