"""Registered queries for the monthly rank charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replaylab.functions import expr as X
from replaylab.operators import charts as C
from replaylab.plans.catalog import minutes_sql, register

ARTIST = ["artist_name"]
TRACK = ["track_name", "artist_name"]


def chart_ctes(keys: list[str], limit: int, by: list[str] | None = None) -> str:
    """DuckDB CTEs pm, monthly, top, rng, spine, chart, feat, life, ranked, cells."""
    by = by or []
    k = ", ".join(keys)
    bc = "".join(f"{b}, " for b in by)
    part = ("PARTITION BY " + ", ".join(by)) if by else ""
    part_m = "PARTITION BY " + ", ".join([*by, "month_start"])
    tie = ", ".join(f"{c} ASC NULLS LAST" for c in keys)

    def eq(a: str, b: str, cols: list[str]) -> str:
        return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols) or "TRUE"

    return f"""
pm AS (SELECT {bc}CAST(date_trunc('month', ts) AS DATE) AS month_start, {k},
              sum(ms_played) AS ms, count(*) AS streams
       FROM history WHERE {keys[0]} IS NOT NULL GROUP BY ALL),
monthly AS (SELECT * FROM pm WHERE month_start IS NOT NULL),
top AS (SELECT *, row_number() OVER ({part_m} ORDER BY ms DESC NULLS LAST, streams DESC, {tie}) AS rank
        FROM monthly QUALIFY rank <= {limit}),
rng AS (SELECT {bc}min(month_start) AS range_start, max(month_start) AS range_end FROM top
        {'GROUP BY ' + ', '.join(by) if by else ''}),
spine AS (SELECT {bc}CAST(unnest(generate_series(range_start, range_end, INTERVAL 1 MONTH)) AS DATE) AS month_start
          FROM rng),
carried AS (SELECT sp.*, (SELECT max(t.month_start) FROM top t
                          WHERE {eq('t', 'sp', by)} AND t.month_start <= sp.month_start) AS src
            FROM spine sp),
chart AS (SELECT {''.join(f'c.{b}, ' for b in by)}c.month_start, c.src, {', '.join('t.' + x for x in keys)},
                 t.rank, t.ms, t.streams
          FROM carried c JOIN top t ON {eq('t', 'c', by)} AND t.month_start = c.src),
feat AS (SELECT {bc}{k}, count(*) AS chart_months, min(month_start) AS first_month,
                arg_min(rank, month_start) AS first_rank
         FROM chart GROUP BY ALL),
life AS (SELECT {bc}{k}, CAST(sum(streams) AS BIGINT) AS total_streams,
                CAST(coalesce(sum(ms), 0) AS BIGINT) AS total_ms
         FROM pm GROUP BY ALL),
ranked AS (SELECT f.*, l.total_streams, l.total_ms,
                  row_number() OVER ({part.replace('PARTITION BY ', 'PARTITION BY f.') if by else ''}
                                     ORDER BY l.total_ms DESC, f.first_month, f.first_rank) AS rank
           FROM feat f JOIN life l ON {eq('f', 'l', [*by, *keys])}),
cells AS (SELECT {''.join(f'r.{b}, ' for b in by)}r.rank, {', '.join('r.' + x for x in keys)},
                 r.total_streams, r.total_ms, strftime(sp.month_start, '%Y-%m') AS month,
                 CAST(coalesce(c.rank, {limit + 1}) AS INTEGER) AS month_rank
          FROM ranked r JOIN spine sp ON {eq('r', 'sp', by)}
          LEFT JOIN chart c ON {eq('c', 'r', [*by, *keys])} AND c.month_start = sp.month_start)"""


# Registered SQL strings are wrapped in "WITH history AS (...)" by the catalog,
# so the chart CTEs follow it with a comma.
def _q(keys: list[str], limit: int, body: str, by: list[str] | None = None) -> str:
    return f"SELECT * FROM (WITH {chart_ctes(keys, limit, by)}\n{body}) q"


@register("c01_monthly_artist_totals", _q(ARTIST, 8, """
SELECT strftime(month_start, '%Y-%m') AS month, artist_name, CAST(ms AS BIGINT) AS ms, streams FROM monthly"""))
def c01_monthly_artist_totals(h: DataFrame) -> DataFrame:
    """Ms and streams per month and artist."""
    em = C.entity_months(h, C.ARTIST)
    return C.monthly_totals(em).select(
        F.date_format("month_start", "yyyy-MM").alias("month"), "artist_name",
        F.col("ms").cast("bigint").alias("ms"), "streams")


@register("c03_month_spine", _q(ARTIST, 8, """
SELECT strftime(month_start, '%Y-%m') AS month FROM spine"""))
def c03_month_spine(h: DataFrame) -> DataFrame:
    """Dense month spine of the artist chart."""
    ch = C.Chart(h, C.ARTIST, 8)
    return ch.spine.select(F.date_format("month_start", "yyyy-MM").alias("month"))


@register("c04_monthly_top_artists", _q(ARTIST, 8, """
SELECT strftime(month_start, '%Y-%m') AS month, CAST(rank AS INTEGER) AS rank, artist_name,
       CAST(ms AS BIGINT) AS ms, streams FROM top"""))
def c04_monthly_top_artists(h: DataFrame) -> DataFrame:
    """Each month's top 8 artists by ms."""
    ch = C.Chart(h, C.ARTIST, 8)
    return ch.top.select(F.date_format("month_start", "yyyy-MM").alias("month"), "rank", "artist_name",
                         F.col("ms").cast("bigint").alias("ms"), "streams")


@register("c05_carried_chart_artists", _q(ARTIST, 8, """
SELECT strftime(month_start, '%Y-%m') AS month, strftime(src, '%Y-%m') AS source_month,
       CAST(rank AS INTEGER) AS rank, artist_name, src <> month_start AS carried FROM chart"""))
def c05_carried_chart_artists(h: DataFrame) -> DataFrame:
    """Chart with carry-forward of gap months."""
    ch = C.Chart(h, C.ARTIST, 8)
    return ch.chart.select(F.date_format("month_start", "yyyy-MM").alias("month"),
                           F.date_format("src", "yyyy-MM").alias("source_month"),
                           "rank", "artist_name", "carried")


@register("c06_featured_tracks", _q(TRACK, 8, """
SELECT track_name, artist_name, chart_months, strftime(first_month, '%Y-%m') AS first_month,
       CAST(first_rank AS INTEGER) AS first_rank FROM feat"""))
def c06_featured_tracks(h: DataFrame) -> DataFrame:
    """Every track that ever charted, with chart months."""
    ch = C.Chart(h, C.TRACK, 8)
    return ch.featured.select("track_name", "artist_name", "chart_months",
                              F.date_format("first_month", "yyyy-MM").alias("first_month"), "first_rank")


@register("c07_featured_track_lifetime", _q(TRACK, 8, """
SELECT f.track_name, f.artist_name, l.total_streams, l.total_ms
FROM feat f JOIN life l ON f.track_name IS NOT DISTINCT FROM l.track_name
                       AND f.artist_name IS NOT DISTINCT FROM l.artist_name"""))
def c07_featured_track_lifetime(h: DataFrame) -> DataFrame:
    """Lifetime stats of featured tracks (null-safe artist match)."""
    ch = C.Chart(h, C.TRACK, 8)
    return ch.ranked.select("track_name", "artist_name", "total_streams", "total_ms")


@register("c08_featured_artist_order", _q(ARTIST, 8, f"""
SELECT CAST(rank AS INTEGER) AS rank, artist_name, total_streams, {minutes_sql('total_ms')} AS total_minutes
FROM ranked"""))
def c08_featured_artist_order(h: DataFrame) -> DataFrame:
    """Featured artists in lifetime-ms order."""
    ch = C.Chart(h, C.ARTIST, 8)
    return ch.ranked.select("rank", "artist_name", "total_streams", X.minutes("total_ms").alias("total_minutes"))


@register("c09_artist_rank_long", _q(ARTIST, 8, f"""
SELECT CAST(rank AS INTEGER) AS rank, artist_name, total_streams, {minutes_sql('total_ms')} AS total_minutes,
       month, month_rank FROM cells"""))
def c09_artist_rank_long(h: DataFrame) -> DataFrame:
    """C09 flagship: artist rank chart, limit 8, one row per (artist, month)."""
    return C.Chart(h, C.ARTIST, 8).long()


@register("c09_track_rank_long", _q(TRACK, 8, f"""
SELECT CAST(rank AS INTEGER) AS rank, track_name, artist_name, total_streams,
       {minutes_sql('total_ms')} AS total_minutes, month, month_rank FROM cells"""))
def c09_track_rank_long(h: DataFrame) -> DataFrame:
    """Track rank chart, limit 8, long form."""
    return C.Chart(h, C.TRACK, 8).long()


@register("c09_artist_rank_nested", _q(ARTIST, 5, f"""
SELECT CAST(rank AS INTEGER) AS rank, artist_name, total_streams, {minutes_sql('total_ms')} AS total_minutes,
       array_to_string(list(month_rank ORDER BY month), ',') AS monthly_ranks
FROM cells GROUP BY ALL"""))
def c09_artist_rank_nested(h: DataFrame) -> DataFrame:
    """C09 response form (limit 5): ranks as one list per artist (joined as text)."""
    nested = C.Chart(h, C.ARTIST, 5).nested()
    return nested.select("rank", "artist_name", "total_streams", "total_minutes",
                         F.array_join(F.col("monthly_ranks").cast("array<string>"), ",").alias("monthly_ranks"))


@register("c09_artist_rank_by_user", _q(ARTIST, 3, f"""
SELECT username, CAST(rank AS INTEGER) AS rank, artist_name, total_streams,
       {minutes_sql('total_ms')} AS total_minutes, month, month_rank FROM cells""", by=["username"]))
def c09_artist_rank_by_user(h: DataFrame) -> DataFrame:
    """C09 for every listener at once (``by=("username",)``), limit 3."""
    return C.Chart(h, C.ARTIST, 3, by=("username",)).long()


@register("c10_rank_range", _q(TRACK, 8, """
SELECT strftime(range_start, '%Y-%m') AS start_month, strftime(range_end, '%Y-%m') AS end_month,
       CAST(date_diff('month', range_start, range_end) + 1 AS INTEGER) AS total_months,
       array_to_string([strftime(m, '%Y-%m') FOR m IN generate_series(range_start, range_end, INTERVAL 1 MONTH)], ',')
         AS months
FROM rng"""))
def c10_rank_range(h: DataFrame) -> DataFrame:
    """Range header of the track chart (months joined as text)."""
    hd = C.Chart(h, C.TRACK, 8).header()
    return hd.select("start_month", "end_month", "total_months", F.array_join("months", ",").alias("months"))


@register("c11_lifetime_top_tracks", f"""
SELECT CAST(rank AS INTEGER) AS rank, track_name, artist_name, total_streams,
       {minutes_sql('total_ms')} AS total_minutes
FROM (SELECT track_name, artist_name, count(*) AS total_streams,
             CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms,
             row_number() OVER (ORDER BY coalesce(sum(ms_played), 0) DESC, count(*) DESC,
                                track_name ASC NULLS LAST, artist_name ASC NULLS LAST) AS rank
      FROM history WHERE track_name IS NOT NULL GROUP BY track_name, artist_name) t
WHERE rank <= 8""")
def c11_lifetime_top_tracks(h: DataFrame) -> DataFrame:
    """C11: lifetime top 8 tracks by ms (the chart fallback)."""
    return C.lifetime_top(h, C.TRACK, 8)


@register("c11_undated_chart", f"""
SELECT CAST(rank AS INTEGER) AS rank, artist_name, total_streams,
       {minutes_sql('total_ms')} AS total_minutes, '' AS monthly_ranks
FROM (SELECT artist_name, count(*) AS total_streams,
             CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS total_ms,
             row_number() OVER (ORDER BY coalesce(sum(ms_played), 0) DESC, count(*) DESC,
                                artist_name ASC NULLS LAST) AS rank
      FROM history WHERE artist_name IS NOT NULL GROUP BY artist_name) t
WHERE rank <= 8""")
def c11_undated_chart(h: DataFrame) -> DataFrame:
    """C11 end to end: the artist chart of an export whose times are all missing."""
    undated = h.withColumn("ts", F.lit(None).cast("timestamp"))
    nested = C.Chart(undated, C.ARTIST, 8).nested()
    return nested.select("rank", "artist_name", "total_streams", "total_minutes",
                         F.array_join(F.col("monthly_ranks").cast("array<string>"), ",").alias("monthly_ranks"))


_RESAMPLE_SQL = """
base AS (SELECT artist_name, month, month_rank,
                row_number() OVER (PARTITION BY artist_name ORDER BY month) - 1 AS month_idx,
                lead(month_rank) OVER (PARTITION BY artist_name ORDER BY month) AS next_rank
         FROM cells),
stepped AS (SELECT *, unnest(generate_series(0, CASE WHEN next_rank IS NULL THEN 0 ELSE 3 END)) AS step FROM base),
res AS (SELECT artist_name, month, month_idx + step / 4.0 AS position,
               month_rank + (coalesce(next_rank, month_rank) - month_rank) * ((1 - cos((step / 4.0) * pi())) / 2)
                 AS rank_at
        FROM stepped)"""


@register("c13_resampled_artist_ranks", _q(ARTIST, 8, f""", {_RESAMPLE_SQL.strip()}
SELECT artist_name, month, round(position, 6) AS position, round(rank_at, 6) AS rank_at FROM res"""
                                          .replace("\n, ", ", ", 1)))
def c13_resampled_artist_ranks(h: DataFrame) -> DataFrame:
    """Artist ranks at quarter-month steps, cosine-eased."""
    res = C.resample_ranks(C.Chart(h, C.ARTIST, 8).long(), C.ARTIST, steps=4)
    return res.select("artist_name", "month", F.round("position", 6).alias("position"),
                      F.round("rank_at", 6).alias("rank_at"))


@register("c14_on_chart_artists", _q(ARTIST, 8, f""", {_RESAMPLE_SQL.strip()}
SELECT artist_name, month, round(position, 6) AS position, round(rank_at, 6) AS rank_at,
       floor(rank_at + 0.5) = 1 AS is_leader
FROM res WHERE floor(rank_at + 0.5) <= 8"""))
def c14_on_chart_artists(h: DataFrame) -> DataFrame:
    """C14: which artists are drawn at each quarter-month position."""
    res = C.on_chart(C.resample_ranks(C.Chart(h, C.ARTIST, 8).long(), C.ARTIST, steps=4), slots=8)
    return res.select("artist_name", "month", F.round("position", 6).alias("position"),
                      F.round("rank_at", 6).alias("rank_at"), "is_leader")


@register("c13_rank_at_position", _q(ARTIST, 8, """
SELECT artist_name, round(CASE WHEN n = 0 THEN 8.0
            WHEN 10.5 >= n - 1 THEN CAST(ranks[n] AS DOUBLE)
            ELSE ranks[11] + (ranks[12] - ranks[11]) * ((1 - cos(0.5 * pi())) / 2) END, 6) AS rank_at,
       floor(CASE WHEN n = 0 THEN 8.0 WHEN 10.5 >= n - 1 THEN CAST(ranks[n] AS DOUBLE)
            ELSE ranks[11] + (ranks[12] - ranks[11]) * ((1 - cos(0.5 * pi())) / 2) END + 0.5) <= 8 AS on_chart
FROM (SELECT artist_name, list(month_rank ORDER BY month) AS ranks, count(*) AS n FROM cells GROUP BY artist_name) t"""))
def c13_rank_at_position(h: DataFrame) -> DataFrame:
    """C13/C14 at one moment (month index 10.5): each artist's eased rank and visibility."""
    nested = C.Chart(h, C.ARTIST, 8).nested()
    r = C.rank_at("monthly_ranks", 10.5, slots=8)
    return nested.select("artist_name", F.round(r, 6).alias("rank_at"),
                         (F.floor(r + F.lit(0.5)) <= 8).alias("on_chart"))


@register("c15_month_labels", _q(TRACK, 8, """
SELECT strftime(month_start, '%Y-%m') AS month, strftime(month_start, '%B %Y') AS label_long,
       upper(strftime(month_start, '%b ''%y')) AS label_short, month(month_start) = 1 AS is_january
FROM spine"""))
def c15_month_labels(h: DataFrame) -> DataFrame:
    """Labels for every month of the track chart's timeline."""
    sp = C.Chart(h, C.TRACK, 8).spine.select(F.date_format("month_start", "yyyy-MM").alias("month"))
    return C.month_labels(sp)


@register("c16_shared_range", """
SELECT strftime(min(s), '%Y-%m') AS start_month, strftime(max(e), '%Y-%m') AS end_month,
       CAST(date_diff('month', min(s), max(e)) + 1 AS INTEGER) AS total_months
FROM (SELECT min(CAST(date_trunc('month', ts) AS DATE)) AS s, max(CAST(date_trunc('month', ts) AS DATE)) AS e
      FROM history WHERE artist_name IS NOT NULL AND ts IS NOT NULL
      UNION ALL
      SELECT min(CAST(date_trunc('month', ts) AS DATE)), max(CAST(date_trunc('month', ts) AS DATE))
      FROM history WHERE track_name IS NOT NULL AND ts IS NOT NULL) t""")
def c16_shared_range(h: DataFrame) -> DataFrame:
    """One timeline covering both the artist and the track chart."""
    a = C.Chart(h, C.ARTIST, 8).ranges
    t = C.Chart(h, C.TRACK, 8).ranges
    hd = C.rank_range(C.shared_range(a, t))
    return hd.select("start_month", "end_month", "total_months")


@register("f16_artist_rank_velocity", _q(ARTIST, 8, """
SELECT artist_name, month, month_rank,
       lag(month_rank) OVER (PARTITION BY artist_name ORDER BY month) AS prev_rank,
       lag(month_rank) OVER (PARTITION BY artist_name ORDER BY month) - month_rank AS rank_change
FROM cells"""))
def f16_artist_rank_velocity(h: DataFrame) -> DataFrame:
    """F16: month-over-month rank change of every featured artist."""
    return C.rank_velocity(C.Chart(h, C.ARTIST, 8).long(), C.ARTIST)
