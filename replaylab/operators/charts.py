"""Monthly rank charts.

Plan shape (one user or ``by=("username",)`` for many):

1. ``entity_months``: ONE aggregate of ``history`` by (by, month, entity);
   month is NULL for undated rows.  Partial aggregation absorbs hot
   entities map-side.  Lifetime totals (C07) are a window over it
   (``with_lifetime``), so the fact table is scanned and shuffled once.
2. ``monthly_top``: ``row_number() <= limit`` per (by, month), planned as
   ``WindowGroupLimit`` (partial before the shuffle, final after).  This top
   list - at most months x limit rows per group - is checkpointed.
3. Everything after reads only the checkpoint: ``carry_lists`` explodes each
   data month's list up to the month before the next data month (one range
   window), ``featured`` and ``order_featured`` aggregate and rank the
   carried rows.  The nested rank matrix looks each month up in the entity's
   own (month, rank) map; the long form explodes the months and equi-joins
   the carried rows (null-safe keys).  No cross join.

The checkpoint is made on first use of the top list; the month range alone
(C03, C10, C15, C16) needs neither: one aggregate gives it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replaylab.functions import expr as X
from replaylab.operators._common import (
    By, attach_group_stats, by_list, key_order, materialize, null_safe_join, top_k,
)

ARTIST = ("artist_name",)
TRACK = ("track_name", "artist_name")


def _month_seq(start: str, end: str) -> Column:
    return F.sequence(F.col(start), F.col(end), F.expr("INTERVAL 1 MONTH"))


# ------------------------------------------------------------------ C01 / C07 base

def entity_months(h: DataFrame, keys: Sequence[str], by: By = (), tz: str | None = None) -> DataFrame:
    """(by, month_start, keys) -> ms (SUM, not coalesced), streams.

    ``month_start`` is the first day of the UTC month (or local month in ``tz``), NULL for undated rows.
    Only the first key must be non-null (a track with unknown artist counts).
    """
    by, keys = by_list(by), list(keys)
    return (
        h.where(F.col(keys[0]).isNotNull())
        .groupBy(*by, F.trunc(X.day("ts", tz), "month").alias("month_start"), *keys)
        .agg(F.sum("ms_played").alias("ms"), F.count(F.lit(1)).alias("streams"))
    )


def monthly_totals(em: DataFrame) -> DataFrame:
    """Dated part of :func:`entity_months`."""
    return em.where(F.col("month_start").isNotNull())


def lifetime(em: DataFrame, keys: Sequence[str], by: By = ()) -> DataFrame:
    """Lifetime streams and ms per entity, undated rows included."""
    by, keys = by_list(by), list(keys)
    return em.groupBy(*by, *keys).agg(
        F.sum("streams").cast("bigint").alias("total_streams"),
        F.coalesce(F.sum("ms"), F.lit(0)).cast("bigint").alias("total_ms"),
    )


# ------------------------------------------------------------------ C03-C06

def monthly_top(monthly: DataFrame, keys: Sequence[str], limit: int, by: By = ()) -> DataFrame:
    """Each month's top ``limit`` by ms DESC, streams DESC (then keys)."""
    order = [F.col("ms").desc_nulls_last(), F.col("streams").desc(), *key_order(keys)]
    return top_k(monthly, [*by_list(by), "month_start"], order, limit)


def month_ranges(top: DataFrame, by: By = ()) -> DataFrame:
    """First and last month with charted data, per group."""
    by = by_list(by)
    # A key-less aggregate of nothing is one all-NULL row: drop it.
    return top.groupBy(*by).agg(
        F.min("month_start").alias("range_start"), F.max("month_start").alias("range_end")
    ).where(F.col("range_start").isNotNull())


def month_ranges_of(h: DataFrame, keys: Sequence[str], by: By = (), tz: str | None = None) -> DataFrame:
    """The same ranges straight from ``history``: one map-side aggregate of dated, named rows.

    A month with such a row always has a top list, so the result is the same.
    """
    dated = h.where(F.col(list(keys)[0]).isNotNull() & F.col("ts").isNotNull())
    ends = dated.groupBy(*by_list(by)).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).where(F.col("lo").isNotNull())
    return ends.select(*by_list(by), F.trunc(X.day("lo", tz), "month").alias("range_start"),
                       F.trunc(X.day("hi", tz), "month").alias("range_end"))


def month_spine(ranges: DataFrame, by: By = ()) -> DataFrame:
    """Every month from first to last, inclusive, across year ends."""
    by = by_list(by)
    return ranges.select(*by, F.explode(_month_seq("range_start", "range_end")).alias("month_start"))


def carry_lists(top: DataFrame, by: By = ()) -> DataFrame:
    """C05 without a spine join: each data month's list holds until the next data month.

    ``next`` = the first later month with data, from ONE range window over the
    top list (integer month index, ``RANGE 1 FOLLOWING``); each list row is then
    exploded over [month, next - 1 month].  Gap months repeat the latest list.
    """
    by = by_list(by)
    idx = F.year("month_start") * 12 + F.month("month_start")
    w = (Window.partitionBy(*[F.col(b) for b in by]).orderBy(idx)
         .rangeBetween(1, Window.unboundedFollowing))
    nxt = F.min("month_start").over(w)
    last = F.coalesce(F.add_months(nxt, -1), F.col("month_start"))
    rows = top.withColumn("src", F.col("month_start")).withColumn("__last", last)
    return rows.withColumn(
        "month_start", F.explode(F.sequence(F.col("src"), F.col("__last"), F.expr("INTERVAL 1 MONTH")))
    ).drop("__last").withColumn("carried", F.col("src") != F.col("month_start"))


def featured(chart: DataFrame, keys: Sequence[str], by: By = (), with_ranks: bool = False) -> DataFrame:
    """Every entity that ever charted, with chart months (carried included).

    Lifetime totals ride along when the chart rows carry them (one aggregate),
    and with ``with_ranks`` a map from chart month to rank.
    """
    by, keys = by_list(by), list(keys)
    extra = []
    if "total_ms" in chart.columns:
        extra = [F.max("total_streams").alias("total_streams"), F.max("total_ms").alias("total_ms")]
    return chart.groupBy(*by, *keys).agg(
        F.count(F.lit(1)).alias("chart_months"),
        F.min("month_start").alias("first_month"),
        F.min_by("rank", "month_start").alias("first_rank"),
        *extra,
        *([F.map_from_entries(F.collect_list(F.struct("month_start", "rank"))).alias("rank_of_month")] if with_ranks else []),
    )


def order_featured(feat: DataFrame, by: By = ()) -> DataFrame:
    """Global order by lifetime ms DESC; ties keep first-appearance order."""
    by = by_list(by)
    w = Window.partitionBy(*[F.col(b) for b in by]).orderBy(
        F.col("total_ms").desc(), F.col("first_month").asc(), F.col("first_rank").asc()
    )
    return feat.withColumn("rank", F.row_number().over(w))


# ------------------------------------------------------------------ C09-C12

def rank_long(ranked: DataFrame, chart: DataFrame, ranges: DataFrame, keys: Sequence[str],
              limit: int, by: By = ()) -> DataFrame:
    """C09 (long form): position per featured entity and month, else ``limit + 1``."""
    by, keys = by_list(by), list(keys)
    cells = attach_group_stats(ranked, ranges, by).select(
        *by, "rank", *keys, "total_streams", "total_ms",
        F.explode(_month_seq("range_start", "range_end")).alias("month_start"),
    )
    positions = chart.select(*by, "month_start", *keys, F.col("rank").alias("month_rank"))
    out = null_safe_join(cells, positions, [*by, "month_start", *keys], how="left")
    return out.select(
        *by, "rank", *keys, "total_streams",
        X.minutes("total_ms").alias("total_minutes"),
        X.month_key("month_start").alias("month"),
        F.coalesce(F.col("month_rank"), F.lit(limit + 1)).cast("int").alias("month_rank"),
    )


def rank_nested(ranked: DataFrame, ranges: DataFrame, keys: Sequence[str], limit: int, by: By = ()) -> DataFrame:
    """C09 (nested) from entities that carry their ``rank_of_month`` map: no explode, no join of cells."""
    by, keys = by_list(by), list(keys)
    months = _month_seq("range_start", "range_end")
    return attach_group_stats(ranked, ranges, by).select(
        *by, "rank", *keys, "total_streams", X.minutes("total_ms").alias("total_minutes"),
        F.transform(months, lambda m: F.coalesce(F.try_element_at("rank_of_month", m), F.lit(limit + 1)).cast("int")).alias("monthly_ranks"),
    )


def nest_ranks(long: DataFrame, keys: Sequence[str], by: By = ()) -> DataFrame:
    """C09 (nested): ``monthly_ranks`` array in month order per entity."""
    by, keys = by_list(by), list(keys)
    pairs = F.array_sort(F.collect_list(F.struct("month", "month_rank")))
    return long.groupBy(*by, "rank", *keys, "total_streams", "total_minutes").agg(
        F.transform(pairs, lambda p: p["month_rank"]).alias("monthly_ranks")
    )


def rank_range(ranges: DataFrame, by: By = ()) -> DataFrame:
    """``start_month, end_month, total_months, months`` per group."""
    by = by_list(by)
    seq = _month_seq("range_start", "range_end")
    return ranges.select(
        *by,
        X.month_key("range_start").alias("start_month"),
        X.month_key("range_end").alias("end_month"),
        F.size(seq).alias("total_months"),
        F.transform(seq, lambda m: F.date_format(m, "yyyy-MM")).alias("months"),
    )


def lifetime_top(h: DataFrame, keys: Sequence[str], limit: int, by: By = ()) -> DataFrame:
    """C11: lifetime top ``limit`` by ms then streams (fallback without dated rows)."""
    by, keys = by_list(by), list(keys)
    totals = h.where(F.col(keys[0]).isNotNull()).groupBy(*by, *keys).agg(
        F.count(F.lit(1)).alias("total_streams"),
        F.coalesce(F.sum("ms_played"), F.lit(0)).cast("bigint").alias("total_ms"),
    )
    return top_of_lifetime(totals, keys, limit, by)


def top_of_lifetime(totals: DataFrame, keys: Sequence[str], limit: int, by: By = ()) -> DataFrame:
    """C11 on lifetime totals (by, keys, total_streams, total_ms)."""
    by, keys = by_list(by), list(keys)
    order = [F.col("total_ms").desc(), F.col("total_streams").desc(), *key_order(keys)]
    return top_k(totals, by, order, limit).select(
        *by, "rank", *keys, "total_streams", X.minutes("total_ms").alias("total_minutes"),
    )


def with_lifetime(em: DataFrame, keys: Sequence[str], by: By = ()) -> DataFrame:
    """C07 in place: lifetime totals of each entity on every (month, entity) row.

    A window over the month aggregate (at most one row per month and entity),
    so no second pass over ``history`` and no join is needed.
    """
    by, keys = by_list(by), list(keys)
    w = Window.partitionBy(*[F.col(c) for c in [*by, *keys]])
    return em.select(
        "*",
        F.sum("streams").over(w).cast("bigint").alias("total_streams"),
        F.coalesce(F.sum("ms").over(w), F.lit(0)).cast("bigint").alias("total_ms"),
    )


class Chart:
    """The whole monthly chart pipeline for one entity kind.

    ``history`` is read once: one aggregate by (by, month, entity), lifetime
    totals by a window on it, then each month's top ``limit``.  That top list
    (at most months x limit rows per group) is checkpointed, and every later
    step - spine, carry-forward, featured set, rank matrix - reads only it.
    Building a chart runs nothing; the first use of the top list makes the
    checkpoint.  Set ``materialize_top=False`` to keep everything in one plan.
    ``tz`` buckets by local months of that zone.
    """

    def __init__(self, h: DataFrame, keys: Sequence[str] = ARTIST, limit: int = 10, by: By = (),
                 materialize_top: bool = True, tz: str | None = None):
        if limit < 1:
            raise ValueError("limit must be >= 1")
        self.keys, self.limit, self.by = list(keys), limit, by_list(by)
        self.history, self.tz, self.materialize_top = h, tz, materialize_top
        self.entity_months = entity_months(h, self.keys, self.by, tz)
        self.monthly = monthly_totals(self.entity_months)

    @cached_property
    def top(self) -> DataFrame:
        top = monthly_top(monthly_totals(with_lifetime(self.entity_months, self.keys, self.by)),
                          self.keys, self.limit, self.by)
        return materialize(top) if self.materialize_top else top

    @property
    def ranges(self) -> DataFrame:
        if "top" in self.__dict__:  # the top list is there already: no scan
            return month_ranges(self.top, self.by)
        return month_ranges_of(self.history, self.keys, self.by, self.tz)

    @property
    def spine(self) -> DataFrame:
        return month_spine(self.ranges, self.by)

    @cached_property
    def chart(self) -> DataFrame:
        return carry_lists(self.top, self.by)

    @cached_property
    def featured(self) -> DataFrame:
        return featured(self.chart, self.keys, self.by)

    @cached_property
    def ranked(self) -> DataFrame:
        return order_featured(self.featured, self.by)

    @property
    def lifetime(self) -> DataFrame:
        """C07 over every entity (a separate aggregate; the chart itself never needs it)."""
        return lifetime(self.entity_months, self.keys, self.by)

    def long(self) -> DataFrame:
        return rank_long(self.ranked, self.chart, self.ranges, self.keys, self.limit, self.by)

    def header(self) -> DataFrame:
        return rank_range(self.ranges, self.by)

    def fallback(self) -> DataFrame:
        """C11 rows for groups that have no dated row at all.

        Such a group's entity rows are ALL undated, so only ``ts IS NULL`` rows
        can contribute: the filter reaches the Parquet scan (row groups without
        nulls are skipped by their statistics) and the result is exact.
        """
        undated = self.history.where(F.col("ts").isNull())
        top = lifetime_top(undated, self.keys, self.limit, self.by)
        if self.by:
            return null_safe_join(top, self.ranges.select(*self.by), self.by, how="left_anti")
        # One group: the (checkpointed, tiny) range frame says whether any
        # dated row exists; skip the lifetime scan entirely when it does.
        if self.ranges.take(1):
            return top.limit(0)
        return top

    def nested(self) -> DataFrame:
        """C09-C11 response rows: ``rank, keys, total_streams, total_minutes, monthly_ranks``."""
        ranked = order_featured(featured(self.chart, self.keys, self.by, with_ranks=True), self.by)
        dated = rank_nested(ranked, self.ranges, self.keys, self.limit, self.by)
        empty = F.array().cast("array<int>")
        fb = self.fallback().select(*self.by, "rank", *self.keys, "total_streams", "total_minutes",
                                    empty.alias("monthly_ranks"))
        return dated.unionByName(fb)


# ------------------------------------------------------------------ C13-C16, F16

def resample_ranks(long: DataFrame, keys: Sequence[str], steps: int = 4, by: By = ()) -> DataFrame:
    """Rank at fractional month positions, cosine-eased between months.

    For each month index ``i`` and step ``s < steps`` the position is
    ``i + s/steps``; past the last month the series is clamped (one row).
    """
    by, keys = by_list(by), list(keys)
    w = Window.partitionBy(*[F.col(c) for c in [*by, *keys]]).orderBy("month")
    base = long.select(
        *by, *keys, "month", "month_rank",
        (F.row_number().over(w) - 1).alias("month_idx"),
        F.lead("month_rank").over(w).alias("next_rank"),
    )
    stepped = base.select(
        "*", F.explode(F.sequence(F.lit(0), F.when(F.col("next_rank").isNull(), F.lit(0))
                                  .otherwise(F.lit(steps - 1)))).alias("step")
    )
    frac = F.col("step") / F.lit(float(steps))
    eased = (F.lit(1.0) - F.cos(frac * F.lit(math.pi))) / F.lit(2.0)
    r1 = F.col("month_rank").cast("double")
    r2 = F.coalesce(F.col("next_rank"), F.col("month_rank")).cast("double")
    return stepped.select(
        *by, *keys, "month",
        (F.col("month_idx") + frac).alias("position"),
        (r1 + (r2 - r1) * eased).alias("rank_at"),
    )


def rank_at(ranks: Column | str, position: float, slots: int = 8) -> Column:
    """C13 at one moment: the rank a ``monthly_ranks`` array shows at ``position``.

    Clamped to the first / last month outside [0, len - 1], cosine-eased
    between the two neighbouring months inside, and ``slots`` for an empty
    series (an undated fallback entity).
    """
    r = F.col(ranks) if isinstance(ranks, str) else ranks
    n = F.size(r)
    i = int(math.floor(position))
    frac = position - i
    eased = (1 - math.cos(frac * math.pi)) / 2
    r1 = F.element_at(r, F.lit(i + 1)).cast("double") if position > 0 else None
    r2 = F.element_at(r, F.lit(i + 2)).cast("double") if position > 0 else None
    inside = (r1 + (r2 - r1) * F.lit(eased)) if position > 0 else F.lit(None).cast("double")
    return (
        F.when(n == 0, F.lit(float(slots)))
        .when(F.lit(position <= 0), F.element_at(r, 1).cast("double"))
        .when(F.lit(float(position)) >= (n - 1).cast("double"), F.element_at(r, n).cast("double"))
        .otherwise(inside)
    )


def on_chart(df: DataFrame, rank_col: str = "rank_at", slots: int = 8) -> DataFrame:
    """C14: entities visible at a moment (``round(rank) <= slots``), leader flagged."""
    shown = F.floor(F.col(rank_col) + F.lit(0.5))
    return df.where(shown <= slots).withColumn("is_leader", shown == 1)


def month_labels(df: DataFrame, month_col: str = "month") -> DataFrame:
    """``January 2024`` / ``JAN '24`` labels, January flagged."""
    start = F.to_date(F.concat(F.col(month_col), F.lit("-01")))
    return df.select(
        "*",
        X.month_long_label(start).alias("label_long"),
        X.month_short_label(start).alias("label_short"),
        (F.month(start) == 1).alias("is_january"),
    )


def shared_range(*ranges: DataFrame, by: By = ()) -> DataFrame:
    """One timeline covering every given series' month range."""
    by = by_list(by)
    union = ranges[0]
    for r in ranges[1:]:
        union = union.unionByName(r)
    return union.groupBy(*by).agg(
        F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end")
    )


def rank_velocity(long: DataFrame, keys: Sequence[str], by: By = ()) -> DataFrame:
    """F16: month-over-month rank change (positive = climbed)."""
    by, keys = by_list(by), list(keys)
    w = Window.partitionBy(*[F.col(c) for c in [*by, *keys]]).orderBy("month")
    prev = F.lag("month_rank").over(w)
    return long.select(
        *by, *keys, "month", "month_rank",
        prev.alias("prev_rank"),
        (prev - F.col("month_rank")).alias("rank_change"),
    )
