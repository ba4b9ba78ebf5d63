"""Registered streaming queries.

Each runs its stream to completion with ``trigger(availableNow=True)`` into
a checkpointed Parquet sink under the shared checkpoint folder, then returns
the sink as a batch DataFrame.  The oracles model the watermark: only windows
and sessions the final watermark (max event time - delay) closed are emitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replaylab.functions import expr as X
from replaylab.plans.catalog import register_raw
from replaylab.session import scratch_folder
from replaylab.sources import history_store as HS
from replaylab.sources.export_json import to_export
from replaylab.sources.plays import (
    EVENT_PLAYS_SQL, PLAYS_SQL, event_plays, events_to_history, lineitems_to_plays, plays,
)
from replaylab.streaming import daily, runs
from replaylab.streaming import pipelines as P


@register_raw("s01_incremental_ingest", f"""
WITH history AS ({EVENT_PLAYS_SQL})
SELECT username, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS total_ms FROM history GROUP BY username""")
def s01_incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental append of new source files, exactly once (run twice, no doubling)."""
    sink, ckpt = P.scratch(spark, "s01")
    for _ in range(2):  # the second run finds no new file in the checkpoint's log
        stream = events_to_history(P.table_stream(spark, sf_dir, "events")).withColumn("year", X.year("ts"))
        P.run_available_now(stream, sink, ckpt, partition_by=("year",))
    out = spark.read.parquet(sink)
    return out.groupBy("username").agg(F.count(F.lit(1)).alias("plays"),
                                       F.sum("ms_played").cast("bigint").alias("total_ms"))


@register_raw("s02_stream_dedup", f"""
WITH history AS ({PLAYS_SQL})
SELECT username, count(*) AS rows_after_dedup FROM (
  SELECT DISTINCT username, ts, coalesce(track_uri, episode_uri) AS item FROM history) t
GROUP BY username""")
def s02_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed line items (stream-static joins) de-duplicated within the watermark."""
    sink, ckpt = P.scratch(spark, "s02")
    stream = lineitems_to_plays(spark, sf_dir, P.table_stream(spark, sf_dir, "lineitem"))
    P.run_available_now(P.dedup_stream(stream, delay="30 days"), sink, ckpt)
    return spark.read.parquet(sink).groupBy("username").agg(F.count(F.lit(1)).alias("rows_after_dedup"))


@register_raw("s03_daily_windows", f"""
WITH history AS ({EVENT_PLAYS_SQL}),
wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM history)
SELECT CAST(ts AS DATE) AS day, count(*) AS streams, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms
FROM history WHERE ts IS NOT NULL GROUP BY 1
HAVING CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS TIMESTAMP) <= (SELECT w FROM wm)""")
def s03_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily tumbling windows over the events stream, watermark 1 hour."""
    sink, ckpt = P.scratch(spark, "s03")
    stream = events_to_history(P.table_stream(spark, sf_dir, "events"))
    P.run_available_now(P.daily_windows(stream, delay="1 hour"), sink, ckpt)
    return spark.read.parquet(sink)


@register_raw("s04_sessions", f"""
WITH history AS ({EVENT_PLAYS_SQL}),
wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM history),
o AS (SELECT username, ts, ms_played,
             CASE WHEN lag(ts) OVER (PARTITION BY username ORDER BY ts) IS NULL
                    OR ts >= lag(ts) OVER (PARTITION BY username ORDER BY ts) + INTERVAL 30 MINUTE
                  THEN 1 ELSE 0 END AS new_session
      FROM history WHERE username IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT *, sum(new_session) OVER (PARTITION BY username ORDER BY ts
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM o),
g AS (SELECT username, min(ts) AS s_start, max(ts) + INTERVAL 30 MINUTE AS s_end, count(*) AS plays,
             CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms
      FROM s GROUP BY username, sid)
SELECT username, strftime(s_start, '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       strftime(s_end, '%Y-%m-%d %H:%M:%S.%f') AS session_end, plays, total_ms
FROM g WHERE s_end <= (SELECT w FROM wm)""")
def s04_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30-minute-gap listening sessions per user over the events stream."""
    sink, ckpt = P.scratch(spark, "s04")
    stream = events_to_history(P.table_stream(spark, sf_dir, "events"))
    P.run_available_now(P.sessions(stream, gap="30 minutes", delay="1 hour"), sink, ckpt)
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return spark.read.parquet(sink).select(
        "username", F.date_format("session_start", fmt).alias("session_start"),
        F.date_format("session_end", fmt).alias("session_end"), "plays", "total_ms")


@register_raw("s01_json_stream", f"""
WITH history AS (SELECT username, ms_played FROM ({PLAYS_SQL}) p UNION ALL SELECT username, ms_played FROM ({EVENT_PLAYS_SQL}) e
                 UNION ALL SELECT username, ms_played FROM ({EVENT_PLAYS_SQL}) e2)
SELECT username, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS total_ms FROM history GROUP BY username""")
def s01_json_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S01 and A08 into one store: an upload, a JSON stream (run twice), another upload; nothing lost or doubled."""
    store, ckpt = P.scratch(spark, "s01-json")
    drop = scratch_folder(spark, "s01-drop")
    HS.append_history(plays(spark, sf_dir), store)
    to_export(event_plays(spark, sf_dir)).write.json(drop)
    for _ in range(2):
        P.ingest_to_store(spark, drop, store, ckpt)
    HS.append_history(event_plays(spark, sf_dir), store)
    return HS.load_history(spark, store).groupBy("username").agg(
        F.count(F.lit(1)).alias("plays"), F.sum("ms_played").cast("bigint").alias("total_ms"))


@register_raw("s02_dedup_any_order", f"""
WITH history AS ({EVENT_PLAYS_SQL})
SELECT username, count(*) AS rows_after_dedup FROM (
  SELECT DISTINCT username, ts, coalesce(track_uri, episode_uri, artist_name) AS item FROM history) t
GROUP BY username""")
def s02_dedup_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half of the events arrives first, then all of them again; each play is stored once."""
    store, ckpt = P.scratch(spark, "s02-any")
    drop = scratch_folder(spark, "s02-drop")
    events = event_plays(spark, sf_dir)
    middle = events.agg(F.percentile_approx(F.unix_micros("ts"), 0.5).alias("m"))
    later = events.where(F.unix_micros("ts") >= middle.scalar())
    for part in (later, events):
        to_export(part).write.mode("append").json(drop)
        P.dedup_into_store(spark, drop, store, ckpt)
    return HS.load_history(spark, store).groupBy("username").agg(F.count(F.lit(1)).alias("rows_after_dedup"))


@register_raw("s03_daily_any_order", f"""
WITH history AS ({EVENT_PLAYS_SQL}),
kept AS (SELECT *, row_number() OVER (PARTITION BY username, ts, artist_name ORDER BY ms_played ASC NULLS FIRST) AS nth FROM history)
SELECT username, CAST(ts AS DATE) AS day, count(*) AS streams, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms
FROM kept WHERE nth = 1 AND ts IS NOT NULL GROUP BY username, CAST(ts AS DATE)""")
def s03_daily_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S02 and S03 in one stream: the later half arrives first, then all events; late plays correct their days."""
    store, ckpt = P.scratch(spark, "s03-any")
    drop, days = scratch_folder(spark, "s03-drop"), scratch_folder(spark, "s03-days")
    events = event_plays(spark, sf_dir)
    middle = events.agg(F.percentile_approx(F.unix_micros("ts"), 0.5).alias("m"))
    later = events.where(F.unix_micros("ts") >= middle.scalar())
    for part in (later, events):
        to_export(part).write.mode("append").json(drop)
        P.dedup_into_store(spark, drop, store, ckpt, days=days)
    return daily.day_totals(spark, days, by=("username",))


@register_raw("s04_sessions_any_order", f"""
WITH history AS ({EVENT_PLAYS_SQL}),
o AS (SELECT username, ts, ms_played, ts < lag(ts) OVER (PARTITION BY username ORDER BY ts) + INTERVAL 30 MINUTE AS goes_on
      FROM history WHERE ts IS NOT NULL),
s AS (SELECT *, count(*) FILTER (WHERE goes_on IS NOT TRUE) OVER (PARTITION BY username ORDER BY ts
                                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM o)
SELECT username, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
       count(*) AS plays, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms
FROM s GROUP BY username, sid""")
def s04_sessions_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S04 kept by a stream of files whose later half arrives first: every session whole, none dropped as late."""
    store, ckpt = P.scratch(spark, "s04-any")
    drop, kept = scratch_folder(spark, "s04-drop"), scratch_folder(spark, "s04-runs")
    events = event_plays(spark, sf_dir)
    # Every other half hour comes late, so that most sessions are pieced together from both batches.
    late = F.pmod(F.call_function("div", F.unix_micros("ts"), F.lit(1_800_000_000)), F.lit(2)) == 0
    for part in (events.where(~late), events.where(late | late.isNull())):
        to_export(part).write.mode("append").json(drop)
        P.ingest_to_store(spark, drop, store, ckpt, run_path=kept)
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return runs.sessions(spark, kept).select("username", F.date_format("session_start", fmt).alias("session_start"),
                                             F.date_format("session_end", fmt).alias("session_end"), "plays", "total_ms")
