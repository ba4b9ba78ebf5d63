"""Per-listener queries over plays whose listener is partly unknown (NULL): a group like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replaylab.operators import activity as A
from replaylab.operators import charts as C
from replaylab.operators import metrics as M
from replaylab.operators import skips as S
from replaylab.plans.catalog import minutes_sql, register
from replaylab.plans.q_charts import ARTIST, _q

BY = ("username",)


@register("c09_artist_rank_unknown_listener", _q(ARTIST, 3, f"""
SELECT username, CAST(rank AS INTEGER) AS rank, artist_name, total_streams,
       {minutes_sql('total_ms')} AS total_minutes, month, month_rank FROM cells""", by=["username"]), source="anon")
def c09_artist_rank_unknown_listener(h: DataFrame) -> DataFrame:
    """C09 long form for every listener, the unknown one too."""
    return C.Chart(h, C.ARTIST, 3, by=BY).long()


@register("c09_artist_rank_nested_unknown_listener", _q(ARTIST, 3, f"""
SELECT username, CAST(rank AS INTEGER) AS rank, artist_name, total_streams, {minutes_sql('total_ms')} AS total_minutes,
       string_agg(month_rank, ',' ORDER BY month) AS ranks
FROM cells GROUP BY ALL""", by=["username"]), source="anon")
def c09_artist_rank_nested_unknown_listener(h: DataFrame) -> DataFrame:
    """C09 nested form for every listener, the unknown one too."""
    out = C.Chart(h, C.ARTIST, 3, by=BY).nested()
    return out.select("username", "rank", "artist_name", "total_streams", "total_minutes",
                      F.array_join("monthly_ranks", ",").alias("ranks"))


@register("d02_calendar_grid_unknown_listener", """
WITH d AS (SELECT username, CAST(ts AS DATE) AS day, count(*) AS streams FROM history
           WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01' GROUP BY ALL),
u AS (SELECT DISTINCT username FROM d),
cells AS (SELECT username, CAST(unnest(generate_series(DATE '1995-12-31', DATE '1997-01-04', INTERVAL 1 DAY)) AS DATE) AS day FROM u)
SELECT c.username, c.day, CAST(CASE WHEN year(c.day) = 1996 THEN coalesce(d.streams, 0) ELSE 0 END AS BIGINT) AS count,
       year(c.day) = 1996 AS in_range
FROM cells c LEFT JOIN d ON d.day = c.day AND d.username IS NOT DISTINCT FROM c.username""", source="anon")
def d02_calendar_grid_unknown_listener(h: DataFrame) -> DataFrame:
    """D02 for every listener, the unknown one too."""
    grid = A.calendar_grid(A.daily_counts(h, year=1996, by=BY), 1996, by=BY)
    return grid.select("username", "day", "count", "in_range")


@register("e01_ts_histogram_unknown_listener", """
WITH t AS (SELECT username, epoch_us(ts) AS t FROM history WHERE ts IS NOT NULL),
b AS (SELECT username, min(t) AS lo, max(t) AS hi FROM t GROUP BY username),
binned AS (SELECT t.username, CASE WHEN hi = lo THEN 0 ELSE least(19, ((t - lo) * 20) // (hi - lo)) END AS bin
           FROM t JOIN b ON t.username IS NOT DISTINCT FROM b.username),
c AS (SELECT username, bin, count(*) AS cnt FROM binned GROUP BY ALL),
grid AS (SELECT username, lo, hi, unnest(generate_series(0, 19)) AS bin FROM b)
SELECT g.username, CAST(g.bin AS INTEGER) AS bin, g.lo + (CAST(g.bin AS BIGINT) * (g.hi - g.lo)) // 20 AS bin_start_us,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN c ON c.bin = g.bin AND c.username IS NOT DISTINCT FROM g.username""", source="anon")
def e01_ts_histogram_unknown_listener(h: DataFrame) -> DataFrame:
    """E01 for every listener, the unknown one too (20 bins)."""
    return A.ts_histogram(h, 20, by=BY)


@register("e12_most_hated_unknown_listener", """
SELECT username, artist_name, total_plays, skips, round(low, 6) AS low, round(global_rate, 6) AS global_rate, CAST(rank AS INTEGER) AS rank
FROM (SELECT w.*, row_number() OVER (PARTITION BY w.username ORDER BY low DESC NULLS LAST, artist_name ASC NULLS LAST) AS rank, g.global_rate
  FROM (SELECT *, (skip_rate + 1.959963984540054*1.959963984540054 / (2.0 * total_plays))
            / (1 + 1.959963984540054*1.959963984540054 / total_plays)
          - 1.959963984540054 * sqrt(skip_rate * (1 - skip_rate) / total_plays
            + 1.959963984540054*1.959963984540054 / (4.0 * total_plays * total_plays))
            / (1 + 1.959963984540054*1.959963984540054 / total_plays) AS low
        FROM (SELECT username, artist_name, count(ts) AS total_plays,
                     CAST(count(*) FILTER (WHERE ts IS NOT NULL AND coalesce(skipped, false)) AS BIGINT) AS skips,
                     count(*) FILTER (WHERE ts IS NOT NULL AND coalesce(skipped, false)) / count(ts) AS skip_rate
              FROM history WHERE artist_name IS NOT NULL
              GROUP BY username, artist_name HAVING count(ts) >= 20) s) w
  JOIN (SELECT username, avg(CAST(skipped AS DOUBLE)) AS global_rate FROM history GROUP BY username) g
    ON g.username IS NOT DISTINCT FROM w.username) t
WHERE rank <= 3""", source="anon")
def e12_most_hated_unknown_listener(h: DataFrame) -> DataFrame:
    """E12 for every listener, the unknown one too: 3 most hated artists and the listener's own skip rate."""
    out = S.most_hated(h, S.ARTIST, n=3, min_plays=20, by=BY)
    return S.rounded(out, ["low", "global_rate"]).select("username", "artist_name", "total_plays", "skips", "low", "global_rate", "rank")


@register("f13_last_6_months_unknown_listener", """
SELECT username, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms, count(*) AS streams
FROM (SELECT *, max(ts) OVER (PARTITION BY username) AS as_of FROM history) t
WHERE ts > as_of - INTERVAL 6 MONTH AND ts <= as_of
GROUP BY username""", source="anon")
def f13_last_6_months_unknown_listener(h: DataFrame) -> DataFrame:
    """F13 preset for every listener, the unknown one too."""
    r = M.preset_range(h, "last_6_months", by=BY)
    return r.groupBy("username").agg(
        F.coalesce(F.sum("ms_played"), F.lit(0)).cast("bigint").alias("total_ms"), F.count(F.lit(1)).alias("streams"))


@register("d01_daily_counts_local", """
SELECT CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS day, count(*) AS streams,
       CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms
FROM history WHERE ts IS NOT NULL GROUP BY 1""", source="events")
def d01_daily_counts_local(h: DataFrame) -> DataFrame:
    """D01 by local days of a time zone (events feed)."""
    return A.daily_counts(h, tz="America/New_York").select("day", "streams", "total_ms")
