"""Scalar, top-k and breakdown metrics over ``history``.

Every operator is lazy and takes ``by``: extra grouping keys such as
``("username",)`` so the same job serves one listener or millions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replaylab.functions import expr as X
from replaylab.operators._common import (
    By, attach_group_stats, by_list, key_order, null_safe_join, round6, top_k,
)

ARTIST = ("artist_name",)
ALBUM = ("album_name", "artist_name")
TRACK = ("track_name", "artist_name")
SHOW = ("episode_show_name",)
EPISODE = ("episode_uri", "episode_name", "episode_show_name")


def _sum_ms() -> Column:
    return F.coalesce(F.sum("ms_played"), F.lit(0)).cast("bigint")


# ------------------------------------------------------------------ B01/B02/B08

def total_time(h: DataFrame, by: By = ()) -> DataFrame:
    """B01+B02: total listening time over all rows, in ms, minutes, hours, days."""
    by = by_list(by)
    agg = h.groupBy(*by).agg(_sum_ms().alias("total_ms"))
    return agg.select(
        *by, "total_ms",
        X.minutes("total_ms").alias("total_minutes"),
        X.hours("total_ms").alias("total_hours"),
        X.days("total_ms").alias("total_days"),
    )


def row_count(h: DataFrame, by: By = ()) -> DataFrame:
    """Number of rows of the table."""
    by = by_list(by)
    return h.groupBy(*by).agg(F.count(F.lit(1)).alias("total_rows"))


def overview_cards(h: DataFrame, by: By = (), approx: bool = False) -> DataFrame:
    """B01+B08+F01+F02 in ONE scan: total time, plays, unique songs, active days.

    The overview page shows these cards together; one aggregate serves them
    all (the distinct counts share a single Expand, or use HyperLogLog++
    sketches with ``approx`` so no distinct values are shuffled).
    """
    by = by_list(by)
    day = X.day("ts")
    if approx:
        songs, days_ = F.approx_count_distinct("track_uri"), F.approx_count_distinct(day)
    else:
        songs, days_ = F.count_distinct("track_uri"), F.count_distinct(day)
    agg = h.groupBy(*by).agg(
        _sum_ms().alias("total_ms"),
        F.count(F.lit(1)).alias("total_rows"),
        songs.alias("unique_songs"),
        days_.alias("active_days"),
    )
    return agg.select(*by, "total_ms", X.minutes("total_ms").alias("total_minutes"),
                      "total_rows", "unique_songs", "active_days")


# ------------------------------------------------------------------ B03-B07, B09

def entity_totals(h: DataFrame, keys: Sequence[str], by: By = ()) -> DataFrame:
    """Streams and ms per entity; only the first key must be non-null."""
    by, keys = by_list(by), list(keys)
    return (
        h.where(F.col(keys[0]).isNotNull())
        .groupBy(*by, *keys)
        .agg(F.count(F.lit(1)).alias("total_streams"), _sum_ms().alias("total_ms"))
    )


def top_entities(h: DataFrame, keys: Sequence[str], n: int = 1, order: str = "streams",
                 by: By = ()) -> DataFrame:
    """Top ``n`` entities per ``by`` group by stream count (or ``order="ms"``)."""
    keys = list(keys)
    if order == "streams":
        sort = [F.col("total_streams").desc(), *key_order(keys)]
    elif order == "ms":
        sort = [F.col("total_ms").desc(), *key_order(keys)]
    else:
        raise ValueError(f"unknown order {order!r}")
    ranked = top_k(entity_totals(h, keys, by), by_list(by), sort, n)
    return ranked.select(
        *by_list(by), "rank", *keys, "total_streams", "total_ms",
        X.minutes("total_ms").alias("total_minutes"),
    )


def top_artist(h: DataFrame, n: int = 1, order: str = "streams", by: By = ()) -> DataFrame:
    """Top artists."""
    return top_entities(h, ARTIST, n, order, by)


def top_album(h: DataFrame, n: int = 1, order: str = "streams", by: By = ()) -> DataFrame:
    """Top albums keyed by (album, artist)."""
    return top_entities(h, ALBUM, n, order, by)


def top_track(h: DataFrame, n: int = 1, order: str = "streams", by: By = ()) -> DataFrame:
    """Top tracks keyed by (track, artist)."""
    return top_entities(h, TRACK, n, order, by)


def or_default(top1: DataFrame, keys: Sequence[str], by: By = (),
               groups: DataFrame | None = None) -> DataFrame:
    """A top-1 result, or names NULL / streams 0 / minutes 0 when empty.

    Without ``by`` a global aggregate always yields exactly one row.  With
    ``by``, ``groups`` (one row per group, e.g. the distinct users) is left
    joined to the result.
    """
    by, keys = by_list(by), list(keys)
    if not by:
        return top1.agg(
            *[F.max(k).alias(k) for k in keys],
            F.coalesce(F.max("total_streams"), F.lit(0)).cast("bigint").alias("total_streams"),
            F.coalesce(F.max("total_minutes"), F.lit(0.0)).alias("total_minutes"),
        )
    if groups is None:
        raise ValueError("groups is required with by")
    joined = null_safe_join(groups.select(*by), top1, by, how="left")
    return joined.select(
        *by, *keys,
        F.coalesce("total_streams", F.lit(0)).cast("bigint").alias("total_streams"),
        F.coalesce("total_minutes", F.lit(0.0)).alias("total_minutes"),
    )


def with_labels(df: DataFrame, title: str = "track_name", subtitle: str = "artist_name") -> DataFrame:
    """Display labels with defaults and a ``N streams`` caption."""
    # Default labels of the chart.
    return df.select(
        "*",
        X.with_default(title, "Unknown Track").alias("title"),
        X.with_default(subtitle, "Unknown Artist").alias("subtitle"),
        F.concat(F.coalesce(F.col("total_streams"), F.lit(0)).cast("string"),
                 F.lit(" streams")).alias("streams_label"),
    )


# ------------------------------------------------------------------ F01-F03

def unique_songs(h: DataFrame, by: By = (), approx: bool = False, rsd: float = 0.05) -> DataFrame:
    """distinct ``track_uri`` (exact, or HyperLogLog++ with ``approx``)."""
    by = by_list(by)
    if approx:
        c = F.approx_count_distinct("track_uri", rsd).alias("unique_songs")
    else:
        c = F.count_distinct("track_uri").alias("unique_songs")
    return h.groupBy(*by).agg(c)


def active_days(h: DataFrame, by: By = ()) -> DataFrame:
    """distinct calendar days with at least one play."""
    by = by_list(by)
    return h.groupBy(*by).agg(F.count_distinct(X.day("ts")).alias("active_days"))


def peak_day(h: DataFrame, by: By = ()) -> DataFrame:
    """the day with the most streams (earliest day on ties)."""
    by = by_list(by)
    daily = (
        h.where(F.col("ts").isNotNull())
        .groupBy(*by, X.day("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("streams"), _sum_ms().alias("total_ms"))
    )
    top = top_k(daily, by, [F.col("streams").desc(), F.col("day").asc()], 1)
    return top.select(*by, "day", "streams", "total_ms")


# ------------------------------------------------------------------ F08-F12

def breakdown(h: DataFrame, dim: str, by: By = ()) -> DataFrame:
    """streams, ms and shares per value of ``dim`` (platform, country)."""
    by = by_list(by)
    agg = h.groupBy(*by, dim).agg(
        F.count(F.lit(1)).alias("streams"), _sum_ms().alias("total_ms")
    )
    # The window runs over the aggregate (one row per dim value), not raw rows.
    w = Window.partitionBy(*[F.col(b) for b in by])
    tot_s = F.sum("streams").over(w)
    tot_ms = F.sum("total_ms").over(w)
    return agg.select(
        *by, dim, "streams", "total_ms",
        X.minutes("total_ms").alias("total_minutes"),
        round6(F.col("streams") / tot_s).alias("stream_share"),
        round6(F.when(tot_ms > 0, F.col("total_ms") / tot_ms).otherwise(F.lit(0.0))).alias("ms_share"),
    )


def top_show(h: DataFrame, n: int = 1, by: By = ()) -> DataFrame:
    """top podcast shows by streams."""
    return top_entities(h, SHOW, n, "streams", by)


def top_episode(h: DataFrame, n: int = 1, by: By = ()) -> DataFrame:
    """top podcast episodes by streams."""
    return top_entities(h, EPISODE, n, "streams", by)


def reason_breakdown(h: DataFrame, by: By = ()) -> DataFrame:
    """plays per (reason_start, reason_end) with skip counts and rate."""
    by = by_list(by)
    agg = h.groupBy(*by, "reason_start", "reason_end").agg(
        F.count(F.lit(1)).alias("streams"),
        F.count_if(F.col("skipped")).cast("bigint").alias("skips"),
        F.count("skipped").alias("known_skip"),
    )
    return agg.select(
        *by, "reason_start", "reason_end", "streams", "skips",
        round6(F.when(F.col("known_skip") > 0, F.col("skips") / F.col("known_skip"))).alias("skip_rate"),
    )


def reason_matrix(h: DataFrame, by: By = (), values: Sequence[str] | None = None) -> DataFrame:
    """F11 (pivot): plays per start reason (rows) x end reason (columns).

    Pass ``values`` (the end reasons) to skip the extra job Spark runs to find
    the distinct pivot values; either way the pivot is one aggregate.
    """
    by = by_list(by)
    g = h.groupBy(*by, "reason_start")
    piv = g.pivot("reason_end", list(values)) if values is not None else g.pivot("reason_end")
    return piv.agg(F.count(F.lit(1)))


#: The breakdown cards: name, and the one or two columns whose values it lists.
CARDS = (("platform", ("platform",)), ("country", ("conn_country",)), ("reasons", ("reason_start", "reason_end")),
         ("shuffle", ("shuffle",)), ("offline", ("offline",)), ("incognito", ("incognito_mode",)))


def breakdown_cards(h: DataFrame, by: By = ()) -> DataFrame:
    """F08, F09, F11, F12 in one scan: (by, card, value, value2, streams, total_ms, skips, known_skips, shares, skip_rate).

    Plays are first counted by all the cards' columns together, map-side; the grouping sets then expand those few combinations
    and not the plays.  Null is a value like any other; flags are the texts ``true`` and ``false``.
    """
    by, dims = by_list(by), [c for _, columns in CARDS for c in columns]
    combos = h.groupBy(*by, *dims).agg(F.count(F.lit(1)).alias("n"), _sum_ms().alias("ms"),
                                       F.count_if(F.col("skipped")).alias("s"), F.count("skipped").alias("k"))
    combos = combos.withColumns({d: F.col(d).cast("string") for d in dims})
    sets = combos.groupingSets([[*by, *columns] for _, columns in CARDS], *by, *dims).agg(
        F.grouping_id().alias("__gid"), F.sum("n").cast("bigint").alias("streams"), F.sum("ms").cast("bigint").alias("total_ms"),
        F.sum("s").cast("bigint").alias("skips"), F.sum("k").cast("bigint").alias("known_skips"))

    def of(position: int) -> Column:
        """The card's value at ``position``: grouping_id has a bit for each column that the set leaves out."""
        out = None
        for name, columns in CARDS:
            value = F.lit(name) if position < 0 else F.col(columns[position]) if position < len(columns) else F.lit(None).cast("string")
            left_out = sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in columns)
            out = F.when(F.col("__gid") == left_out, value) if out is None else out.when(F.col("__gid") == left_out, value)
        return out

    w = Window.partitionBy(*by, "card")
    all_ms = F.sum("total_ms").over(w)
    rows = sets.select(*by, of(-1).alias("card"), of(0).alias("value"), of(1).alias("value2"), "streams", "total_ms", "skips", "known_skips")
    return rows.withColumns({
        "stream_share": round6(F.col("streams") / F.sum("streams").over(w)),
        "ms_share": round6(F.when(all_ms > 0, F.col("total_ms") / all_ms).otherwise(F.lit(0.0))),
        "skip_rate": round6(F.when(F.col("known_skips") > 0, F.col("skips") / F.col("known_skips"))),
    })


def habit_shares(h: DataFrame, by: By = ()) -> DataFrame:
    """share of plays in shuffle, offline and incognito mode (nulls excluded)."""
    by = by_list(by)
    return h.groupBy(*by).agg(
        round6(F.avg(F.col("shuffle").cast("double"))).alias("shuffle_share"),
        round6(F.avg(F.col("offline").cast("double"))).alias("offline_share"),
        round6(F.avg(F.col("incognito_mode").cast("double"))).alias("incognito_share"),
    )


# ------------------------------------------------------------------ F13/F14

def date_range(h: DataFrame, start: str | None = None, end: str | None = None, slack_days: int = 0) -> DataFrame:
    """half-open ``[start, end)`` filter on ``ts`` (pushed to the scan).

    On a stored history, whose partition column is ``year``, the implied year range prunes whole
    folders.  Texts without an offset are UTC.  ``slack_days`` widens the range on both sides.
    """
    cond, slack = F.lit(True), dt.timedelta(days=slack_days)
    stored = dict(h.dtypes).get("year") == "int"
    if start is not None:
        t = _utc(start) - slack
        cond = cond & (F.col("ts") >= X.instant(t.isoformat()))
        if stored:
            cond = cond & (F.col("year") >= t.year)
    if end is not None:
        t = _utc(end) + slack
        cond = cond & (F.col("ts") < X.instant(t.isoformat()))
        if stored:
            cond = cond & (F.col("year") <= (t - dt.timedelta(microseconds=1)).year)
    return h.where(cond)


def _utc(text: str) -> dt.datetime:
    t = dt.datetime.fromisoformat(text)
    return t.replace(tzinfo=dt.UTC) if t.tzinfo is None else t.astimezone(dt.UTC)


# The preset windows of the date selector.
PRESETS = {"last_4_weeks": lambda t: X.days_before(t, 28), "last_6_months": lambda t: X.months_before(t, 6)}


def preset_range(h: DataFrame, preset: str, by: By = (), as_of: str | None = None) -> DataFrame:
    """F13 presets: rows in ``(as_of - span, as_of]``; ``as_of`` defaults to max(ts) per group."""
    if preset == "all_time":
        return h
    since = PRESETS[preset](F.col("__as_of"))
    by = by_list(by)
    if as_of is not None:
        anchor = h.select("*", X.instant(as_of).alias("__as_of"))
    else:
        stats = h.groupBy(*by).agg(F.max("ts").alias("__as_of"))
        anchor = attach_group_stats(h, stats, by)
    return anchor.where(
        (F.col("ts") > since) & (F.col("ts") <= F.col("__as_of"))
    ).drop("__as_of")


def dedup_key() -> Column:
    """What was played: the track or episode uri, or all its names where there is neither."""
    names = F.to_json(F.array("track_name", "artist_name", "album_name", "episode_name", "episode_show_name"))
    return F.coalesce(F.col("track_uri"), F.col("episode_uri"), names)


def deduplicate(h: DataFrame) -> DataFrame:
    """one whole row per (username, ts, item) across re-uploaded exports; NULL keys are values too.

    The row that stays is the smallest one, column by column (nulls first): a minimum of structs,
    combined map-side, so a row that a third of the table repeats is cheap.
    """
    first = F.min(F.struct(*[F.col(c) for c in h.columns])).alias("r")
    return h.groupBy("username", "ts", dedup_key().alias("item")).agg(first).select("r.*")


def play_counts(h: DataFrame, by: By = ("username",)) -> DataFrame:
    """F14 as counts: plays per group after de-duplication.  Only keys are shuffled, by a hash aggregate; no whole row is."""
    by = by_list(by)
    keys = list(dict.fromkeys([*by, "username", "ts"]))
    return h.select(*keys, dedup_key().alias("item")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("rows_after_dedup"))


# ------------------------------------------------------------------ F15

def user_leaderboard(h: DataFrame, n: int = 10) -> DataFrame:
    """top ``n`` listeners overall by ms (dense rank; ties share a place)."""
    totals = h.where(F.col("username").isNotNull()).groupBy("username").agg(_sum_ms().alias("total_ms"))
    w = Window.orderBy(F.col("total_ms").desc())
    ranked = totals.withColumn("place", F.dense_rank().over(w)).where(F.col("place") <= n)
    return ranked.select("place", "username", "total_ms", X.minutes("total_ms").alias("total_minutes"))


def artist_leaderboard(h: DataFrame, n: int = 10) -> DataFrame:
    """per artist, the top ``n`` listeners by ms (dense rank within artist).

    The rank limit is applied map-side (``WindowGroupLimit``) before the
    shuffle on artist, so a hot artist sends at most ``n`` places per task.
    """
    totals = (
        h.where(F.col("username").isNotNull() & F.col("artist_name").isNotNull())
        .groupBy("artist_name", "username").agg(_sum_ms().alias("total_ms"))
    )
    w = Window.partitionBy("artist_name").orderBy(F.col("total_ms").desc())
    ranked = totals.withColumn("place", F.dense_rank().over(w)).where(F.col("place") <= n)
    return ranked.select("artist_name", "place", "username", "total_ms")
