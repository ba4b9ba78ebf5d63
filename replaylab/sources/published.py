"""Tables that are published by marker: one attempt folder per write, one small marker row that makes it live.

    <path>/attempt=<random>/[partition folders]/part-*.parquet    the rows, each with the name of its unit
    <path>/_live/part-*.json                                      (seq, kind, unit, attempt) markers, one file per publication

A *unit* is whatever is replaced as a whole: an upload, a batch.  A unit's live attempt is that of its newest marker, so writing
a unit again never deletes anything first: until the marker is there, readers see the old attempt, and an attempt that died on
the way is never seen.  :func:`compact` rewrites many units into one attempt and publishes it with one marker file; a unit that is
written again meanwhile, or later, stays with its own newer attempt.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKS = "seq long, kind int, unit string, attempt string"
#: Live attempts named in a scan's filter; beyond it they are joined, with the same rows.
MAX_LISTED = 2000


def _mark(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").json(f"{path}/_live")


def _write(df: DataFrame, path: str, partition_by: tuple[str, ...], options: dict[str, str] | None = None) -> str:
    attempt = uuid.uuid4().hex
    writer = df.write.options(**(options or {}))
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.parquet(f"{path}/attempt={attempt}")
    return attempt


def publish(df: DataFrame, path: str, unit: str, partition_by: tuple[str, ...] = (), column: str = "unit") -> None:
    """Write ``df`` as unit ``unit`` and make it live, in place of an earlier write of the unit."""
    path, seq = path.rstrip("/"), time.time_ns() // 1000
    attempt = _write(df.withColumn(column, F.lit(unit)), path, partition_by)
    _mark(df.sparkSession.createDataFrame([(seq, 0, unit, attempt)], MARKS), path)


def publish_units(df: DataFrame, path: str, units: DataFrame, partition_by: tuple[str, ...] = (), options: dict[str, str] | None = None) -> None:
    """Write many units at once: ``df`` names each row's unit in a column of its own, ``units`` (unit) lists them, empty ones too."""
    path, seq = path.rstrip("/"), time.time_ns() // 1000
    attempt = _write(df, path, partition_by, options)
    _mark(units.select(F.lit(seq).alias("seq"), F.lit(0).alias("kind"), "unit", F.lit(attempt).alias("attempt")), path)


def marks(spark: SparkSession, path: str) -> DataFrame | None:
    """All markers, or None if nothing was published yet."""
    try:
        return spark.read.schema(MARKS).json(f"{path.rstrip('/')}/_live")
    except AnalysisException:
        return None


def live(found: DataFrame) -> DataFrame:
    """(unit, attempt, seq): the newest marker of each unit; a compaction keeps the seq of what it copied."""
    newest = F.max(F.struct("seq", "kind", "attempt")).alias("m")
    return found.groupBy("unit").agg(newest).select("unit", "m.attempt", "m.seq")


def read(spark: SparkSession, path: str, schema: T.StructType, partition_by: T.StructType = T.StructType(), column: str = "unit",
         found: DataFrame | None = None) -> DataFrame | None:
    """The live rows with their unit and partition columns, or None if nothing was published yet."""
    found = marks(spark, path) if found is None else found
    if found is None:
        return None
    fields = [*schema.fields, T.StructField(column, T.StringType()), T.StructField("attempt", T.StringType()), *partition_by.fields]
    df = spark.read.schema(T.StructType(fields)).parquet(path.rstrip("/"))
    pairs = found.select("unit", "attempt").distinct()
    newest = live(found).select(F.col("unit").alias("u"), F.col("attempt").alias("a"))
    state = pairs.join(newest, pairs.unit == newest.u).withColumn("live", F.col("attempt") == F.col("a"))
    # One row per attempt that has a live unit; stale units only where a compacted unit was written again later.
    attempts = state.groupBy("attempt").agg(F.max("live").alias("any"), F.collect_list(F.when(~F.col("live"), F.col("unit"))).alias("stale")).where("any")
    listed = attempts.limit(MAX_LISTED + 1).collect()
    stale = {r.attempt: r.stale for r in listed if r.stale}
    if len(listed) > MAX_LISTED or sum(map(len, stale.values())) > MAX_LISTED:
        alive = newest.select(F.col("u").alias(column), F.col("a").alias("attempt"))
        return df.join(alive, [column, "attempt"], "left_semi").drop("attempt")
    df = df.where(F.col("attempt").isin([r.attempt for r in listed]))  # a partition filter: other folders aren't read
    for attempt, units in stale.items():
        df = df.where(~((F.col("attempt") == attempt) & F.col(column).isin(units)))
    return df.drop("attempt")


def compact(spark: SparkSession, path: str, schema: T.StructType, partition_by: T.StructType = T.StructType(), column: str = "unit",
            cluster_by: tuple[str, ...] = (), keep: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Rewrite all live units into one attempt with few files per partition folder; returns how many units it holds.

    ``keep`` may leave out rows that a reader of the table passes over anyway.
    """
    path, found = path.rstrip("/"), marks(spark, path)
    if found is None:
        return 0
    units = live(found)
    n = units.count()
    rows, folders = read(spark, path, schema, partition_by, column, found), tuple(f.name for f in partition_by.fields)
    if keep:
        rows = keep(rows)
    rows = rows.hint("rebalance", *folders)
    if cluster_by:
        rows = rows.sortWithinPartitions(*folders, *cluster_by)
    attempt = _write(rows, path, folders)
    _mark(units.select("seq", F.lit(1).alias("kind"), "unit", F.lit(attempt).alias("attempt")), path)
    return n


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the attempts that were published once and hold no live unit any more; no reader may still be at work on them."""
    path, found = path.rstrip("/"), marks(spark, path)
    if found is None:
        return 0
    alive = live(found).select("attempt")
    dead = [r.attempt for r in found.select("attempt").distinct().join(alive, "attempt", "left_anti").collect()]
    done = 0
    for attempt in dead:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/attempt={attempt}")
        done += bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))
    return done
