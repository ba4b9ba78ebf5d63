"""Registered queries for skip statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replaylab.operators import skips as S
from replaylab.plans.catalog import register

Z = "1.959963984540054"


def _stats_sql(keys: list[str], min_plays: int = 0) -> str:
    k = ", ".join(keys)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    having = f"HAVING count(ts) >= {min_plays}" if min_plays else ""
    return f"""SELECT {k}, count(ts) AS total_plays,
       CAST(count(*) FILTER (WHERE ts IS NOT NULL AND coalesce(skipped, false)) AS BIGINT) AS skips,
       CASE WHEN count(ts) > 0 THEN count(*) FILTER (WHERE ts IS NOT NULL AND coalesce(skipped, false))
            / count(ts) END AS skip_rate
FROM history WHERE {nn} GROUP BY {k} {having}"""


_GLOBAL = "(SELECT avg(CAST(skipped AS DOUBLE)) FROM history)"


def _wilson_sql(keys: list[str], min_plays: int = 0) -> str:
    return f"""SELECT *, greatest(skip_rate - low, 0.0) AS err_low, greatest(high - skip_rate, 0.0) AS err_high,
       low > global_rate AS robust
FROM (SELECT *, CASE WHEN total_plays > 0 THEN
          (skip_rate + {Z}*{Z} / (2.0 * total_plays)) / (1 + {Z}*{Z} / total_plays)
          - {Z} * sqrt(skip_rate * (1 - skip_rate) / total_plays + {Z}*{Z} / (4.0 * total_plays * total_plays))
            / (1 + {Z}*{Z} / total_plays) END AS low,
        CASE WHEN total_plays > 0 THEN
          (skip_rate + {Z}*{Z} / (2.0 * total_plays)) / (1 + {Z}*{Z} / total_plays)
          + {Z} * sqrt(skip_rate * (1 - skip_rate) / total_plays + {Z}*{Z} / (4.0 * total_plays * total_plays))
            / (1 + {Z}*{Z} / total_plays) END AS high,
        {_GLOBAL} AS global_rate
      FROM ({_stats_sql(keys, min_plays)}) s) w"""


def _r6(cols: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@register("e02_artist_skip_stats", f"""
SELECT artist_name, total_plays, skips, round(skip_rate, 6) AS skip_rate FROM ({_stats_sql(['artist_name'])}) t""")
def e02_artist_skip_stats(h: DataFrame) -> DataFrame:
    """Skip stats per artist."""
    return S.rounded(S.skip_stats(h, S.ARTIST), ["skip_rate"])


@register("e03_track_skip_stats", f"""
SELECT track_name, total_plays, skips, round(skip_rate, 6) AS skip_rate FROM ({_stats_sql(['track_name'])}) t""")
def e03_track_skip_stats(h: DataFrame) -> DataFrame:
    """Skip stats keyed by track name only."""
    return S.rounded(S.skip_stats(h, S.TRACK_NAME), ["skip_rate"])


@register("e04_track_skip_stats_min10", f"""
SELECT track_name, total_plays, skips, round(skip_rate, 6) AS skip_rate
FROM ({_stats_sql(['track_name'], 10)}) t""")
def e04_track_skip_stats_min10(h: DataFrame) -> DataFrame:
    """Tracks with at least 10 plays."""
    return S.rounded(S.skip_stats(h, S.TRACK_NAME, min_plays=10), ["skip_rate"])


@register("e05_most_skipped_tracks", f"""
SELECT track_name, total_plays, skips, round(skip_rate, 6) AS skip_rate, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (ORDER BY skip_rate DESC NULLS LAST, track_name ASC NULLS LAST) AS rank
      FROM ({_stats_sql(['track_name'], 10)}) s) t
WHERE rank <= 10""")
def e05_most_skipped_tracks(h: DataFrame) -> DataFrame:
    """The 10 most skipped tracks (at least 10 plays)."""
    st = S.skip_stats(h, S.TRACK_NAME, min_plays=10)
    return S.rounded(S.most_skipped(st, S.TRACK_NAME, n=10), ["skip_rate"])


def _extremes_sql(keys: list[str], min_plays: int) -> str:
    k = ", ".join(keys)
    tie = ", ".join(f"{c} ASC NULLS LAST" for c in keys)
    base = _stats_sql(keys, min_plays)
    return f"""
SELECT {k}, total_plays, skips, round(skip_rate, 6) AS skip_rate, CAST(rank AS INTEGER) AS rank, tag FROM (
  SELECT *, row_number() OVER (ORDER BY skip_rate DESC NULLS LAST, {tie}) AS rank, 'most_skipped' AS tag
  FROM ({base}) a QUALIFY rank <= 5
  UNION ALL
  SELECT *, row_number() OVER (ORDER BY total_plays DESC, {tie}) AS rank, 'most_played' AS tag
  FROM ({base}) b QUALIFY rank <= 4) t"""


@register("e06_artist_skip_extremes", _extremes_sql(["artist_name"], 30))
def e06_artist_skip_extremes(h: DataFrame) -> DataFrame:
    """Artist scatter labels (>= 30 plays): top 5 by rate, top 4 by plays."""
    st = S.skip_stats(h, S.ARTIST, min_plays=30)
    return S.rounded(S.skip_extremes(st, S.ARTIST, 5, 4), ["skip_rate"])


@register("e06_track_skip_extremes", _extremes_sql(["track_name"], 20))
def e06_track_skip_extremes(h: DataFrame) -> DataFrame:
    """Track scatter labels (>= 20 plays)."""
    st = S.skip_stats(h, S.TRACK_NAME, min_plays=20)
    return S.rounded(S.skip_extremes(st, S.TRACK_NAME, 5, 4), ["skip_rate"])


@register("e07_global_skip_rate", "SELECT round(avg(CAST(skipped AS DOUBLE)), 6) AS global_rate FROM history")
def e07_global_skip_rate(h: DataFrame) -> DataFrame:
    """Global skip rate."""
    return S.rounded(S.global_skip_rate(h), ["global_rate"])


_PV_SQL = f"""
WITH s AS ({_stats_sql(['artist_name'])}),
g AS (SELECT {_GLOBAL} AS global_rate),
terms AS (SELECT s.*, g.global_rate, unnest(generate_series(s.skips, s.total_plays)) AS i FROM s, g),
pv AS (SELECT artist_name, total_plays, skips, skip_rate, global_rate,
              least(sum(exp(lgamma(total_plays + 1) - lgamma(i + 1) - lgamma(total_plays - i + 1)
                            + i * ln(global_rate) + (total_plays - i) * ln(1 - global_rate))), 1.0) AS p_value
       FROM terms GROUP BY ALL)
SELECT *, 0.0 - log10(greatest(p_value, 1e-300)) AS neg_log_p FROM pv"""

_SURPRISE_SQL = f"""
SELECT artist_name, total_plays, skips, round(skip_rate, 6) AS skip_rate, round(global_rate, 6) AS global_rate,
       round(p_value, 6) AS p_value, round(neg_log_p, 6) AS neg_log_p, p_value < 0.05 AS significant
FROM ({_PV_SQL}) q"""


@register("e08_artist_skip_surprise", f"SELECT * FROM ({_SURPRISE_SQL}) q")
def e08_artist_skip_surprise(h: DataFrame) -> DataFrame:
    """Binomial-tail p-value per artist, -log10 p, significance."""
    st = S.rated_skip_stats(h, S.ARTIST)
    out = S.skip_surprise(st)
    return S.rounded(out, ["skip_rate", "global_rate", "p_value", "neg_log_p"]).select(
        "artist_name", "total_plays", "skips", "skip_rate", "global_rate", "p_value", "neg_log_p", "significant")


@register("e10_most_surprising_artists", f"""
SELECT artist_name, total_plays, skips, round(neg_log_p, 6) AS neg_log_p, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY greatest(p_value, 1e-300) ASC, artist_name ASC NULLS LAST) AS rank
  FROM ({_PV_SQL}) q) t WHERE rank <= 5""")
def e10_most_surprising_artists(h: DataFrame) -> DataFrame:
    """The 5 most surprising artists."""
    st = S.rated_skip_stats(h, S.ARTIST)
    top = S.most_surprising(S.skip_surprise(st), S.ARTIST, 5)
    return S.rounded(top, ["neg_log_p"]).select("artist_name", "total_plays", "skips", "neg_log_p", "rank")


_W_COLS = ["skip_rate", "low", "high", "err_low", "err_high", "global_rate"]


@register("e11_artist_wilson", f"""
SELECT artist_name, total_plays, skips, {_r6(_W_COLS)}, robust FROM ({_wilson_sql(['artist_name'])}) t""")
def e11_artist_wilson(h: DataFrame) -> DataFrame:
    """Wilson 95 % interval, whiskers and robust flag per artist."""
    st = S.rated_skip_stats(h, S.ARTIST)
    w = S.wilson(st)
    return S.rounded(w, _W_COLS).select("artist_name", "total_plays", "skips", *_W_COLS, "robust")


def _hated_sql(keys: list[str], n: int, min_plays: int) -> str:
    k = ", ".join(keys)
    tie = ", ".join(f"{c} ASC NULLS LAST" for c in keys)
    return f"""
SELECT {k}, total_plays, skips, {_r6(_W_COLS)}, robust, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY low DESC NULLS LAST, {tie}) AS rank
  FROM ({_wilson_sql(keys, min_plays)}) w) t WHERE rank <= {n}"""


def _hated(h: DataFrame, keys, n: int, min_plays: int) -> DataFrame:
    out = S.most_hated(h, keys, n=n, min_plays=min_plays)
    return S.rounded(out, _W_COLS).select(*keys, "total_plays", "skips", *_W_COLS, "robust", "rank")


@register("e12_most_hated_artists", _hated_sql(["artist_name"], 10, 20))
def e12_most_hated_artists(h: DataFrame) -> DataFrame:
    """Top 10 artists by Wilson lower bound (>= 20 plays)."""
    return _hated(h, list(S.ARTIST), 10, 20)


@register("f06_most_hated_artist", _hated_sql(["artist_name"], 1, 20))
def f06_most_hated_artist(h: DataFrame) -> DataFrame:
    """the most hated artist card."""
    return _hated(h, list(S.ARTIST), 1, 20)


@register("f07_most_hated_track", _hated_sql(["track_name", "artist_name"], 1, 10))
def f07_most_hated_track(h: DataFrame) -> DataFrame:
    """the most hated track card, keyed by (track, artist), >= 10 plays."""
    return _hated(h, list(S.TRACK), 1, 10)


@register("e12_most_hated_by_user", """
SELECT username, artist_name, total_plays, skips, round(low, 6) AS low, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY username ORDER BY low DESC NULLS LAST, artist_name ASC NULLS LAST) AS rank
  FROM (SELECT *, CASE WHEN total_plays > 0 THEN
          (skip_rate + 1.959963984540054*1.959963984540054 / (2.0 * total_plays))
            / (1 + 1.959963984540054*1.959963984540054 / total_plays)
          - 1.959963984540054 * sqrt(skip_rate * (1 - skip_rate) / total_plays
            + 1.959963984540054*1.959963984540054 / (4.0 * total_plays * total_plays))
            / (1 + 1.959963984540054*1.959963984540054 / total_plays) END AS low
        FROM (SELECT username, artist_name, count(ts) AS total_plays,
                     CAST(count(*) FILTER (WHERE ts IS NOT NULL AND coalesce(skipped, false)) AS BIGINT) AS skips,
                     count(*) FILTER (WHERE ts IS NOT NULL AND coalesce(skipped, false)) / count(ts) AS skip_rate
              FROM history WHERE artist_name IS NOT NULL AND username IS NOT NULL
              GROUP BY username, artist_name HAVING count(ts) >= 20) s) w) t
WHERE rank <= 3""")
def e12_most_hated_by_user(h: DataFrame) -> DataFrame:
    """E12 for every listener: each user's 3 most hated artists (>= 20 plays)."""
    out = S.most_hated(h.where(F.col("username").isNotNull()), S.ARTIST, n=3, min_plays=20, by=("username",))
    return S.rounded(out, ["low"]).select("username", "artist_name", "total_plays", "skips", "low", "rank")
