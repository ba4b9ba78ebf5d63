"""Adapters from the driver's test tables to the ``history`` schema.

``plays`` turns the TPC-H-like star schema into one play per line item;
``event_plays`` turns the ``events`` stream table into intra-day plays.
Both are plain projections over joins, so Catalyst prunes every unused column
at the Parquet scan and pushes filters of the caller below the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replaylab.functions import expr as X
from replaylab.schema import HISTORY, HISTORY_COLUMNS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _utc_instant(c: Column, kind: T.DataType) -> Column:
    """A date, zone-less or zoned time as an instant, independent of the session's zone."""
    if isinstance(kind, T.TimestampType):
        return c
    if isinstance(kind, T.DateType):
        return F.timestamp_micros(F.unix_date(c).cast("bigint") * F.lit(X.DAY_US))
    t = c.cast("timestamp_ntz")  # field by field: no zone is involved
    micros = ((F.hour(t) * 60 + F.minute(t)).cast("bigint") * F.lit(60_000_000)
              + (F.date_part(F.lit("SECOND"), t) * F.lit(1_000_000)).cast("bigint"))
    return F.timestamp_micros(F.unix_date(t.cast("date")).cast("bigint") * F.lit(X.DAY_US) + micros)


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``history`` row per line item (see FIXTURES.md §3)."""
    return lineitems_to_plays(spark, sf_dir, _table(spark, sf_dir, "lineitem"))


def lineitems_to_plays(spark: SparkSession, sf_dir: str, li: DataFrame) -> DataFrame:
    """The plays projection for a (batch or streaming) frame of line items.

    The dimension tables are read as static frames, so a streaming ``li``
    becomes a stream-static join.
    """
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # nation is a fixed 25-row dimension: a broadcast with a size bound by definition.
    nation = F.broadcast(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))

    j = (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(part, li.l_partkey == part.p_partkey)
        .join(supplier, li.l_suppkey == supplier.s_suppkey)
        .join(nation, F.col("s_nationkey") == nation.n_nationkey)
    )
    # The driver's tables hold wall-clock times without a zone: they are UTC.
    ts = _utc_instant(F.col("l_shipdate"), li.schema["l_shipdate"].dataType)
    podcast = F.col("l_linenumber") == 7
    gap = (ts >= X.instant("1998-03-01")) & (ts < X.instant("1998-05-01"))
    brand_no = F.expr("try_cast(substr(p_brand, 7) AS INT)")
    cols = {
        "ts": ts,
        "username": F.concat(F.lit("user"), (F.col("o_custkey") % 20).cast("string")),
        "platform": F.col("o_orderpriority"),
        "ms_played": (F.col("l_quantity") * 6000).cast("bigint"),
        "conn_country": F.col("n_name"),
        "track_name": F.when(~podcast, F.col("p_name")),
        "artist_name": F.when(~(podcast | gap), F.col("p_brand")),
        "album_name": F.when(~podcast, F.col("p_type")),
        "track_uri": F.when(~podcast, F.concat(F.lit("track:"), F.col("p_partkey").cast("string"))),
        "episode_name": F.when(podcast, F.col("p_name")),
        "episode_show_name": F.when(podcast, F.col("p_type")),
        "episode_uri": F.when(podcast, F.concat(F.lit("episode:"), F.col("p_partkey").cast("string"))),
        "reason_start": F.col("l_returnflag"),
        "reason_end": F.col("l_linestatus"),
        "shuffle": F.col("l_tax") > 0.04,
        "skipped": F.when(
            (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), F.lit(None)
        ).otherwise(F.col("l_quantity") <= F.lit(10) + brand_no),
        "offline": F.col("l_discount") > 0.05,
        "offline_timestamp": ts,
        "incognito_mode": F.col("l_linestatus") == "O",
    }
    return j.select(*[cols[c].cast(f.dataType).alias(c) for c, f in zip(HISTORY_COLUMNS, HISTORY.fields)])


def anon_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plays with every fifth listener unknown (NULL username): group keys must be null-safe."""
    h = plays(spark, sf_dir)
    return h.withColumn("username", F.when(~F.col("username").isin(*_UNKNOWN), F.col("username")))


def event_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``history`` row per event, microsecond times (intra-day cases)."""
    return events_to_history(_table(spark, sf_dir, "events"))


def events_to_history(ev: DataFrame) -> DataFrame:
    """The events projection for a (batch or streaming) frame of events."""
    cols = {
        "ts": _utc_instant(F.col("ts"), ev.schema["ts"].dataType),
        "username": F.concat(F.lit("user"), F.col("user_id").cast("string")),
        "ms_played": F.floor(F.col("value") * 1000).cast("bigint"),
        "artist_name": F.col("event_type"),
    }
    return ev.select(
        *[(cols.get(c, F.lit(None))).cast(f.dataType).alias(c) for c, f in zip(HISTORY_COLUMNS, HISTORY.fields)]
    )


_UNKNOWN = ("user0", "user5", "user10", "user15")

# DuckDB text of the same adapters, used by the oracle SQL.
PLAYS_SQL = """
SELECT CAST(l_shipdate AS TIMESTAMP) AS ts,
       concat('user', CAST(o_custkey % 20 AS VARCHAR)) AS username,
       o_orderpriority AS platform,
       CAST(l_quantity * 6000 AS BIGINT) AS ms_played,
       n_name AS conn_country,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE p_name END AS track_name,
       CASE WHEN l_linenumber = 7
              OR (l_shipdate >= TIMESTAMP '1998-03-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-05-01 00:00:00')
            THEN NULL ELSE p_brand END AS artist_name,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE p_type END AS album_name,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('track:', CAST(p_partkey AS VARCHAR)) END AS track_uri,
       CASE WHEN l_linenumber = 7 THEN p_name END AS episode_name,
       CASE WHEN l_linenumber = 7 THEN p_type END AS episode_show_name,
       CASE WHEN l_linenumber = 7 THEN concat('episode:', CAST(p_partkey AS VARCHAR)) END AS episode_uri,
       l_returnflag AS reason_start, l_linestatus AS reason_end,
       l_tax > 0.04 AS shuffle,
       CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN NULL
            ELSE l_quantity <= 10 + TRY_CAST(substr(p_brand, 7) AS INT) END AS skipped,
       l_discount > 0.05 AS offline,
       CAST(l_shipdate AS TIMESTAMP) AS offline_timestamp,
       l_linestatus = 'O' AS incognito_mode
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
     JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""

ANON_PLAYS_SQL = f"""
SELECT * REPLACE (CASE WHEN username NOT IN {_UNKNOWN} THEN username END AS username) FROM ({PLAYS_SQL}) p
"""

EVENT_PLAYS_SQL = """
SELECT CAST(ts AS TIMESTAMP) AS ts,
       concat('user', CAST(user_id AS VARCHAR)) AS username,
       CAST(NULL AS VARCHAR) AS platform,
       CAST(floor(value * 1000) AS BIGINT) AS ms_played,
       CAST(NULL AS VARCHAR) AS conn_country,
       CAST(NULL AS VARCHAR) AS track_name,
       event_type AS artist_name,
       CAST(NULL AS VARCHAR) AS album_name,
       CAST(NULL AS VARCHAR) AS track_uri,
       CAST(NULL AS VARCHAR) AS episode_name,
       CAST(NULL AS VARCHAR) AS episode_show_name,
       CAST(NULL AS VARCHAR) AS episode_uri,
       CAST(NULL AS VARCHAR) AS reason_start,
       CAST(NULL AS VARCHAR) AS reason_end,
       CAST(NULL AS BOOLEAN) AS shuffle,
       CAST(NULL AS BOOLEAN) AS skipped,
       CAST(NULL AS BOOLEAN) AS offline,
       CAST(NULL AS TIMESTAMP) AS offline_timestamp,
       CAST(NULL AS BOOLEAN) AS incognito_mode
FROM events
"""
