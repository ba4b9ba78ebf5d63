"""Registered queries for B (scalar / top-1) and F (declared) metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replaylab.functions import expr as X
from replaylab.operators import metrics as M
from replaylab.schema import HISTORY
from replaylab.plans.catalog import DAYS, HOURS, minutes_sql, register


def _top_sql(keys: list[str], n: int, order: str = "streams", where: str = "") -> str:
    k = ", ".join(keys)
    tie = ", ".join(f"{c} ASC NULLS LAST" for c in keys)
    first = "total_streams DESC" if order == "streams" else "total_ms DESC"
    cond = f"{keys[0]} IS NOT NULL" + (f" AND ({where})" if where else "")
    return f"""
SELECT CAST(row_number() OVER (ORDER BY {first}, {tie}) AS INTEGER) AS rank, {k},
       total_streams, total_ms, {minutes_sql('total_ms')} AS total_minutes
FROM (SELECT {k}, count(*) AS total_streams, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms
      FROM history WHERE {cond} GROUP BY {k}) t
QUALIFY rank <= {n}
"""


@register("b01_total_time", f"""
SELECT total_ms, {minutes_sql('total_ms')} AS total_minutes,
       {HOURS.format(ms='total_ms')} AS total_hours, {DAYS.format(ms='total_ms')} AS total_days
FROM (SELECT CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms FROM history) t
""")
def b01_total_time(h: DataFrame) -> DataFrame:
    """Total listening time in minutes, hours and days."""
    return M.total_time(h)


@register("b01_total_time_by_user", f"""
SELECT username, total_ms, {minutes_sql('total_ms')} AS total_minutes,
       {HOURS.format(ms='total_ms')} AS total_hours, {DAYS.format(ms='total_ms')} AS total_days
FROM (SELECT username, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms FROM history GROUP BY username) t
""")
def b01_total_time_by_user(h: DataFrame) -> DataFrame:
    """B01 per listener (``by=("username",)``)."""
    return M.total_time(h, by=("username",))


@register("b00_overview_cards", f"""
SELECT CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms,
       {minutes_sql('CAST(coalesce(sum(ms_played), 0) AS BIGINT)')} AS total_minutes,
       count(*) AS total_rows, count(DISTINCT track_uri) AS unique_songs,
       count(DISTINCT CAST(ts AS DATE)) AS active_days
FROM history""")
def b00_overview_cards(h: DataFrame) -> DataFrame:
    """B01/B08/F01/F02 cards from one scan."""
    return M.overview_cards(h)


@register("b00_overview_cards_by_user", f"""
SELECT username, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms,
       {minutes_sql('CAST(coalesce(sum(ms_played), 0) AS BIGINT)')} AS total_minutes,
       count(*) AS total_rows, count(DISTINCT track_uri) AS unique_songs,
       count(DISTINCT CAST(ts AS DATE)) AS active_days
FROM history GROUP BY username""")
def b00_overview_cards_by_user(h: DataFrame) -> DataFrame:
    """The overview cards of every listener in one job."""
    return M.overview_cards(h, by=("username",))


@register("b03_top_artist", _top_sql(["artist_name"], 1))
def b03_top_artist(h: DataFrame) -> DataFrame:
    """Top artist by stream count."""
    return M.top_artist(h)


@register("b03_top_artist_by_user", """
SELECT username, CAST(rank AS INTEGER) AS rank, artist_name, total_streams, total_ms,
       ((total_ms + 300) // 600) / 100 AS total_minutes
FROM (SELECT username, artist_name, count(*) AS total_streams,
             CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms,
             row_number() OVER (PARTITION BY username ORDER BY count(*) DESC, artist_name ASC NULLS LAST) AS rank
      FROM history WHERE artist_name IS NOT NULL GROUP BY username, artist_name) t
WHERE rank <= 3
""")
def b03_top_artist_by_user(h: DataFrame) -> DataFrame:
    """B03 per listener: each user's top 3 artists."""
    return M.top_artist(h, n=3, by=("username",))


@register("b04_top_album", _top_sql(["album_name", "artist_name"], 1))
def b04_top_album(h: DataFrame) -> DataFrame:
    """Top album keyed by (album, artist)."""
    return M.top_album(h)


@register("b05_top_track", _top_sql(["track_name", "artist_name"], 1))
def b05_top_track(h: DataFrame) -> DataFrame:
    """Top track keyed by (track, artist)."""
    return M.top_track(h)


@register("b06_top_artist_default", """
SELECT g.day, t.artist_name, CAST(coalesce(t.total_streams, 0) AS BIGINT) AS total_streams,
       coalesce(((t.total_ms + 300) // 600) / 100, 0.0) AS total_minutes
FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM history) g
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total_streams DESC, artist_name) AS nth
           FROM (SELECT CAST(ts AS DATE) AS day, artist_name, count(*) AS total_streams,
                        CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms
                 FROM history WHERE artist_name IS NOT NULL GROUP BY 1, 2) a) t
  ON t.day IS NOT DISTINCT FROM g.day AND t.nth = 1
""")
def b06_top_artist_default(h: DataFrame) -> DataFrame:
    """Every day's top artist; days without any artist (the gap months) get the default row."""
    days = h.withColumn("day", X.day("ts"))
    return M.or_default(M.top_artist(days, by=("day",)), ["artist_name"], by=("day",), groups=days.select("day").distinct())


@register("b07_top_artist_by_ms", _top_sql(["artist_name"], 1, order="ms"))
def b07_top_artist_by_ms(h: DataFrame) -> DataFrame:
    """Top artist by total ms."""
    return M.top_artist(h, order="ms")


@register("b08_row_count", "SELECT count(*) AS total_rows FROM history")
def b08_row_count(h: DataFrame) -> DataFrame:
    """Rows in the table."""
    return M.row_count(h)


@register("b09_top10_artists", _top_sql(["artist_name"], 10))
def b09_top10_artists(h: DataFrame) -> DataFrame:
    """Top 10 artists by stream count."""
    return M.top_artist(h, n=10)


@register("b10_track_labels", """
SELECT *, coalesce(nullif(track_name, ''), 'Unknown Track') AS title,
       coalesce(nullif(artist_name, ''), 'Unknown Artist') AS subtitle,
       CAST(total_streams AS VARCHAR) || ' streams' AS streams_label
FROM (""" + _top_sql(["track_name", "artist_name"], 10) + ") x")
def b10_track_labels(h: DataFrame) -> DataFrame:
    """Display labels for the top 10 tracks (null artist -> Unknown Artist)."""
    return M.with_labels(M.top_track(h, n=10))


@register("f01_unique_songs", "SELECT count(DISTINCT track_uri) AS unique_songs FROM history")
def f01_unique_songs(h: DataFrame) -> DataFrame:
    """distinct songs."""
    return M.unique_songs(h)


@register("f02_active_days", "SELECT count(DISTINCT CAST(ts AS DATE)) AS active_days FROM history")
def f02_active_days(h: DataFrame) -> DataFrame:
    """distinct days with plays."""
    return M.active_days(h)


@register("f03_peak_day", """
SELECT day, streams, total_ms FROM (
  SELECT CAST(ts AS DATE) AS day, count(*) AS streams, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms
  FROM history WHERE ts IS NOT NULL GROUP BY 1) t
ORDER BY streams DESC, day ASC LIMIT 1
""")
def f03_peak_day(h: DataFrame) -> DataFrame:
    """the busiest day."""
    return M.peak_day(h)


def _breakdown_sql(dim: str) -> str:
    return f"""
SELECT {dim}, streams, total_ms, ((total_ms + 300) // 600) / 100 AS total_minutes,
       round(streams / sum(streams) OVER (), 6) AS stream_share,
       round(CASE WHEN sum(total_ms) OVER () > 0 THEN total_ms / sum(total_ms) OVER () ELSE 0.0 END, 6) AS ms_share
FROM (SELECT {dim}, count(*) AS streams, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms
      FROM history GROUP BY {dim}) t
"""


@register("f08_platform_breakdown", _breakdown_sql("platform"))
def f08_platform_breakdown(h: DataFrame) -> DataFrame:
    """listening by platform."""
    return M.breakdown(h, "platform")


@register("f09_country_breakdown", _breakdown_sql("conn_country"))
def f09_country_breakdown(h: DataFrame) -> DataFrame:
    """listening by country."""
    return M.breakdown(h, "conn_country")


@register("f10_top_show", _top_sql(["episode_show_name"], 1))
def f10_top_show(h: DataFrame) -> DataFrame:
    """top podcast show."""
    return M.top_show(h)


@register("f10_top_episodes", _top_sql(["episode_uri", "episode_name", "episode_show_name"], 5))
def f10_top_episodes(h: DataFrame) -> DataFrame:
    """top 5 podcast episodes."""
    return M.top_episode(h, n=5)


@register("f11_reason_breakdown", """
SELECT reason_start, reason_end, count(*) AS streams,
       CAST(count(*) FILTER (WHERE skipped) AS BIGINT) AS skips,
       round(CASE WHEN count(skipped) > 0 THEN count(*) FILTER (WHERE skipped) / count(skipped) END, 6) AS skip_rate
FROM history GROUP BY reason_start, reason_end
""")
def f11_reason_breakdown(h: DataFrame) -> DataFrame:
    """start/end reasons with skip rate."""
    return M.reason_breakdown(h)


@register("f11_reason_matrix", """
SELECT reason_start, count(*) FILTER (WHERE reason_end = 'F') AS F,
       count(*) FILTER (WHERE reason_end = 'O') AS O
FROM history GROUP BY reason_start""")
def f11_reason_matrix(h: DataFrame) -> DataFrame:
    """F11 pivot: start reason x end reason counts, a column for every end reason in the table."""
    out = M.reason_matrix(h)
    return out.select("reason_start", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in out.columns[1:]])


_CARDS_SQL = " UNION ALL ".join(f"""
SELECT username, '{card}' AS card, CAST({columns[0]} AS VARCHAR) AS value, {f'CAST({columns[1]} AS VARCHAR)' if columns[1:] else 'CAST(NULL AS VARCHAR)'} AS value2,
       count(*) AS streams, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms,
       CAST(count(*) FILTER (WHERE skipped) AS BIGINT) AS skips, count(skipped) AS known_skips
FROM history GROUP BY ALL""" for card, columns in M.CARDS)


@register("f08_f12_breakdown_cards", f"""
SELECT *, round(streams / sum(streams) OVER w, 6) AS stream_share,
       round(CASE WHEN sum(total_ms) OVER w > 0 THEN total_ms / sum(total_ms) OVER w ELSE 0 END, 6) AS ms_share,
       round(CASE WHEN known_skips > 0 THEN skips / known_skips END, 6) AS skip_rate
FROM ({_CARDS_SQL}) c WINDOW w AS (PARTITION BY username, card)""")
def f08_f12_breakdown_cards(h: DataFrame) -> DataFrame:
    """every listener's breakdown cards from one scan."""
    return M.breakdown_cards(h, by=("username",))


@register("f12_habit_shares", """
SELECT round(avg(CAST(shuffle AS DOUBLE)), 6) AS shuffle_share,
       round(avg(CAST(offline AS DOUBLE)), 6) AS offline_share,
       round(avg(CAST(incognito_mode AS DOUBLE)), 6) AS incognito_share
FROM history
""")
def f12_habit_shares(h: DataFrame) -> DataFrame:
    """habit shares."""
    return M.habit_shares(h)


@register("f12_habit_shares_by_user", """
SELECT username, round(avg(CAST(shuffle AS DOUBLE)), 6) AS shuffle_share,
       round(avg(CAST(offline AS DOUBLE)), 6) AS offline_share,
       round(avg(CAST(incognito_mode AS DOUBLE)), 6) AS incognito_share
FROM history GROUP BY username
""")
def f12_habit_shares_by_user(h: DataFrame) -> DataFrame:
    """F12 per listener."""
    return M.habit_shares(h, by=("username",))


@register("f13_range_total_time", f"""
SELECT total_ms, {minutes_sql('total_ms')} AS total_minutes,
       {HOURS.format(ms='total_ms')} AS total_hours, {DAYS.format(ms='total_ms')} AS total_days
FROM (SELECT CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms FROM history
      WHERE ts >= TIMESTAMP '1996-01-01 00:00:00' AND ts < TIMESTAMP '1997-01-01 00:00:00') t
""")
def f13_range_total_time(h: DataFrame) -> DataFrame:
    """total time inside a half-open date range."""
    return M.total_time(M.date_range(h, "1996-01-01", "1997-01-01"))


@register("f13_last_6_months_by_user", """
SELECT username, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms, count(*) AS streams
FROM (SELECT *, max(ts) OVER (PARTITION BY username) AS as_of FROM history) t
WHERE ts > as_of - INTERVAL 6 MONTH AND ts <= as_of
GROUP BY username
""")
def f13_last_6_months_by_user(h: DataFrame) -> DataFrame:
    """F13 preset: each listener's last six months (relative to their latest play)."""
    r = M.preset_range(h, "last_6_months", by=("username",))
    return r.groupBy("username").agg(
        F.coalesce(F.sum("ms_played"), F.lit(0)).cast("bigint").alias("total_ms"),
        F.count(F.lit(1)).alias("streams"),
    )


@register("f13_last_4_weeks", """
SELECT CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms, count(*) AS streams
FROM history WHERE ts > (SELECT max(ts) FROM history) - INTERVAL 28 DAY AND ts <= (SELECT max(ts) FROM history)
""")
def f13_last_4_weeks(h: DataFrame) -> DataFrame:
    """F13 preset: the last four weeks of the whole table."""
    r = M.preset_range(h, "last_4_weeks")
    return r.agg(
        F.coalesce(F.sum("ms_played"), F.lit(0)).cast("bigint").alias("total_ms"),
        F.count(F.lit(1)).alias("streams"),
    )


@register("f14_dedup_counts", """
SELECT username, count(*) AS rows_after_dedup FROM (
  SELECT DISTINCT username, ts, coalesce(track_uri, episode_uri) AS item FROM history) t
GROUP BY username
""")
def f14_dedup_counts(h: DataFrame) -> DataFrame:
    """rows per listener after cross-export de-duplication."""
    return M.play_counts(h)


_DEDUP_ORDER = ", ".join(f"{f.name} ASC NULLS FIRST" for f in HISTORY.fields)


@register("f14_dedup_rows", f"""
SELECT * EXCLUDE (item, nth) REPLACE (strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts,
                                      strftime(offline_timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') AS offline_timestamp)
FROM (SELECT *, row_number() OVER (PARTITION BY username, ts, item ORDER BY {_DEDUP_ORDER}) AS nth
      FROM (SELECT *, coalesce(track_uri, episode_uri, to_json([track_name, artist_name, album_name, episode_name, episode_show_name])::VARCHAR)
              AS item FROM history) i) d
WHERE nth = 1""")
def f14_dedup_rows(h: DataFrame) -> DataFrame:
    """the whole rows that stay."""
    return M.deduplicate(h).withColumns({c: X.iso_text(c) for c in ("ts", "offline_timestamp")})


@register("f15_user_leaderboard", """
SELECT CAST(place AS INTEGER) AS place, username, total_ms, ((total_ms + 300) // 600) / 100 AS total_minutes
FROM (SELECT username, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms,
             dense_rank() OVER (ORDER BY coalesce(sum(ms_played), 0) DESC) AS place
      FROM history WHERE username IS NOT NULL GROUP BY username) t
WHERE place <= 10
""")
def f15_user_leaderboard(h: DataFrame) -> DataFrame:
    """community leaderboard, top 10 listeners."""
    return M.user_leaderboard(h, n=10)


@register("f15_artist_leaderboard", """
SELECT artist_name, CAST(place AS INTEGER) AS place, username, total_ms
FROM (SELECT artist_name, username, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms,
             dense_rank() OVER (PARTITION BY artist_name ORDER BY coalesce(sum(ms_played), 0) DESC) AS place
      FROM history WHERE username IS NOT NULL AND artist_name IS NOT NULL GROUP BY artist_name, username) t
WHERE place <= 3
""")
def f15_artist_leaderboard(h: DataFrame) -> DataFrame:
    """per artist, the top 3 listeners."""
    return M.artist_leaderboard(h, n=3)
