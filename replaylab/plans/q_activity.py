"""Registered queries for daily activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replaylab.operators import activity as A
from replaylab.plans.catalog import register

_DAILY = """SELECT CAST(ts AS DATE) AS day, count(*) AS streams,
       CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms
FROM history WHERE ts IS NOT NULL {extra} GROUP BY 1"""


@register("d01_daily_counts", f"""
SELECT day, streams, total_ms, ((total_ms + 300) // 600) / 100 AS minutes,
       CAST(floor(streams * 3.2 + 0.5) AS BIGINT) AS est_minutes
FROM ({_DAILY.format(extra='')}) t""")
def d01_daily_counts(h: DataFrame) -> DataFrame:
    """Streams per day with estimated minutes."""
    return A.daily_counts(h)


@register("d01_daily_counts_events", f"""
SELECT day, streams, total_ms, ((total_ms + 300) // 600) / 100 AS minutes,
       CAST(floor(streams * 3.2 + 0.5) AS BIGINT) AS est_minutes
FROM ({_DAILY.format(extra='')}) t""", source="events")
def d01_daily_counts_events(h: DataFrame) -> DataFrame:
    """D01 on the intra-day events feed."""
    return A.daily_counts(h)


@register("d07_daily_counts_1996", f"""
SELECT day, streams, total_ms, ((total_ms + 300) // 600) / 100 AS minutes,
       CAST(floor(streams * 3.2 + 0.5) AS BIGINT) AS est_minutes
FROM ({_DAILY.format(extra="AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01'")}) t""")
def d07_daily_counts_1996(h: DataFrame) -> DataFrame:
    """One selected year (1996)."""
    return A.daily_counts(h, year=1996)


def _grid_sql(year: int, as_of: str | None, extra: str = "") -> str:
    end = f"DATE '{year}-12-31'"
    if as_of is not None:
        end = (f"CASE WHEN year(DATE '{as_of}') = {year} THEN least(DATE '{as_of}', DATE '{year}-12-31') "
               f"ELSE DATE '{year}-12-31' END")
    return f"""
WITH d AS ({_DAILY.format(extra=f"AND ts >= TIMESTAMP '{year}-01-01' AND ts < TIMESTAMP '{year + 1}-01-01' {extra}")}),
b AS (SELECT DATE '{year}-01-01' AS j, {end} AS e),
b2 AS (SELECT j, e, j - CAST(dayofweek(j) AS INTEGER) AS gs,
              e + CAST(6 - dayofweek(e) AS INTEGER) AS ge FROM b),
cells AS (SELECT j, e, gs, CAST(unnest(generate_series(gs, ge, INTERVAL 1 DAY)) AS DATE) AS day FROM b2),
g AS (SELECT c.day, CASE WHEN c.day BETWEEN c.j AND c.e THEN coalesce(d.streams, 0) ELSE 0 END AS cnt,
             c.day BETWEEN c.j AND c.e AS in_range,
             CAST(floor(date_diff('day', c.gs, c.day) / 7) AS INTEGER) AS week,
             CAST(dayofweek(c.day) AS INTEGER) AS dow
      FROM cells c LEFT JOIN d ON d.day = c.day),
g2 AS (SELECT *, CASE WHEN cnt <= 0 THEN 0 WHEN cnt <= 8 THEN 1 WHEN cnt <= 20 THEN 2
                      WHEN cnt <= 40 THEN 3 ELSE 4 END AS level,
              (dow = 0 AND in_range) AS sunday FROM g),
g3 AS (SELECT *, lag(month(day)) OVER (PARTITION BY sunday ORDER BY day) AS prev_m FROM g2)"""


# DuckDB dayofweek: 0 = Sunday; Spark dayofweek: 1 = Sunday (the operator shifts to 0).
@register("d02_calendar_grid_2024", _grid_sql(2024, None) + """
SELECT day, CAST(cnt AS BIGINT) AS count, in_range, week, dow, level,
       CASE WHEN sunday AND (prev_m IS NULL OR prev_m <> month(day)) THEN strftime(day, '%b') END AS month_label
FROM g3""", source="events")
def d02_calendar_grid_2024(h: DataFrame) -> DataFrame:
    """The 2024 calendar grid of the events feed (371 cells)."""
    daily = A.daily_counts(h, year=2024)
    return A.calendar_grid(daily, 2024).select("day", "count", "in_range", "week", "dow", "level", "month_label")


@register("d02_calendar_grid_1997_as_of", _grid_sql(1997, "1997-08-15") + """
SELECT day, CAST(cnt AS BIGINT) AS count, in_range, week, dow, level,
       CASE WHEN sunday AND (prev_m IS NULL OR prev_m <> month(day)) THEN strftime(day, '%b') END AS month_label
FROM g3""")
def d02_calendar_grid_1997_as_of(h: DataFrame) -> DataFrame:
    """D02 for a "current" year cut at an as-of date (1997-08-15)."""
    daily = A.daily_counts(h, year=1997)
    return A.calendar_grid(daily, 1997, as_of="1997-08-15").select(
        "day", "count", "in_range", "week", "dow", "level", "month_label")


@register("d04_activity_summary_1996", _grid_sql(1996, None) + """
SELECT CAST(count(*) FILTER (WHERE in_range AND cnt > 0) AS BIGINT) AS active_days,
       CAST(coalesce(sum(cnt) FILTER (WHERE in_range), 0) AS BIGINT) AS total_streams
FROM g3""")
def d04_activity_summary_1996(h: DataFrame) -> DataFrame:
    """Active days and streams of 1996 (padding excluded)."""
    grid = A.calendar_grid(A.daily_counts(h, year=1996), 1996)
    return A.activity_summary(grid)


@register("e01_ts_histogram", """
WITH t AS (SELECT epoch_us(ts) AS t FROM history WHERE ts IS NOT NULL),
b AS (SELECT min(t) AS lo, max(t) AS hi FROM t),
binned AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(99, ((t - lo) * 100) // (hi - lo)) END AS bin
           FROM t, b),
c AS (SELECT bin, count(*) AS cnt FROM binned GROUP BY bin),
grid AS (SELECT lo, hi, unnest(generate_series(0, 99)) AS bin FROM b)
SELECT CAST(g.bin AS INTEGER) AS bin, g.lo + (CAST(g.bin AS BIGINT) * (g.hi - g.lo)) // 100 AS bin_start_us,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN c ON c.bin = g.bin""", source="events")
def e01_ts_histogram(h: DataFrame) -> DataFrame:
    """100-bin histogram of play times (events feed)."""
    return A.ts_histogram(h, 100)


@register("e01_ts_histogram_plays", """
WITH t AS (SELECT epoch_us(ts) AS t FROM history WHERE ts IS NOT NULL),
b AS (SELECT min(t) AS lo, max(t) AS hi FROM t),
binned AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(99, ((t - lo) * 100) // (hi - lo)) END AS bin
           FROM t, b),
c AS (SELECT bin, count(*) AS cnt FROM binned GROUP BY bin),
grid AS (SELECT lo, hi, unnest(generate_series(0, 99)) AS bin FROM b)
SELECT CAST(g.bin AS INTEGER) AS bin, g.lo + (CAST(g.bin AS BIGINT) * (g.hi - g.lo)) // 100 AS bin_start_us,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN c ON c.bin = g.bin""")
def e01_ts_histogram_plays(h: DataFrame) -> DataFrame:
    """100-bin histogram of play times over the whole plays table."""
    return A.ts_histogram(h, 100)


_ISLANDS = """
WITH d AS (SELECT DISTINCT {by}CAST(ts AS DATE) AS day FROM history WHERE ts IS NOT NULL),
i AS (SELECT *, day - CAST(row_number() OVER ({part} ORDER BY day) AS INTEGER) AS island FROM d),
r AS (SELECT {by}min(day) AS start_day, max(day) AS end_day, count(*) AS length FROM i GROUP BY {by}island)"""


@register("f04_streaks", _ISLANDS.format(by="", part="") + """
SELECT start_day, end_day, length FROM r""")
def f04_streaks(h: DataFrame) -> DataFrame:
    """every run of consecutive active days."""
    return A.streaks(h)


@register("f04_longest_streak_by_user", _ISLANDS.format(by="username, ", part="PARTITION BY username") + """
SELECT username, start_day, end_day, length FROM r
QUALIFY row_number() OVER (PARTITION BY username ORDER BY length DESC, start_day ASC) = 1""", source="events")
def f04_longest_streak_by_user(h: DataFrame) -> DataFrame:
    """each listener's longest streak (events feed)."""
    return A.longest_streak(h, by=("username",)).select("username", "start_day", "end_day", "length")


_WEEKDAY = """
WITH pd AS (SELECT {by}CAST(ts AS DATE) AS day, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS ms
            FROM history WHERE ts IS NOT NULL GROUP BY ALL),
w AS (SELECT {by}CAST(dayofweek(day) + 1 AS INTEGER) AS dow, count(*) AS active_days,
             CAST(sum(ms) AS BIGINT) AS total_ms, sum(ms) / count(*) / 3600000.0 AS avg_hours,
             dayname(day) AS weekday
      FROM pd GROUP BY ALL)"""


@register("f05_weekday_profile", _WEEKDAY.format(by="") + """
SELECT dow, active_days, total_ms, avg_hours, weekday FROM w""", source="events")
def f05_weekday_profile(h: DataFrame) -> DataFrame:
    """mean listening hours per active day, by weekday (events feed)."""
    p = A.weekday_profile(h)
    return p.select("dow", "active_days", "total_ms", "avg_hours", "weekday")


@register("f05_top_weekday_by_user", _WEEKDAY.format(by="username, ") + """
SELECT username, dow, active_days, avg_hours, weekday FROM w
QUALIFY row_number() OVER (PARTITION BY username ORDER BY avg_hours DESC, dow ASC) = 1""", source="events")
def f05_top_weekday_by_user(h: DataFrame) -> DataFrame:
    """each listener's most active weekday."""
    t = A.top_weekday(h, by=("username",))
    return t.select("username", "dow", "active_days", "avg_hours", "weekday")


@register("s04_sessions_batch", """
WITH o AS (SELECT username, ts, ms_played,
                  CASE WHEN lag(ts) OVER (PARTITION BY username ORDER BY ts) IS NULL
                         OR ts >= lag(ts) OVER (PARTITION BY username ORDER BY ts) + INTERVAL 30 MINUTE
                       THEN 1 ELSE 0 END AS new_session
           FROM history WHERE username IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT *, sum(new_session) OVER (PARTITION BY username ORDER BY ts
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM o)
SELECT username, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
       count(*) AS plays, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms
FROM s GROUP BY username, sid""", source="events")
def s04_sessions_batch(h: DataFrame) -> DataFrame:
    """S04 in batch over the whole events feed: 30-minute-gap sessions per listener."""
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    out = A.listening_sessions(h, 30)
    return out.select("username", F.date_format("session_start", fmt).alias("session_start"),
                      F.date_format("session_end", fmt).alias("session_end"), "plays", "total_ms")
