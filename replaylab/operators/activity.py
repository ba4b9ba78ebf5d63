"""Daily activity, calendar grid, histogram, streaks and weekday habits.

(D01-D07, E01, F02-F05.)  Aggregates first; the calendar grid and histogram
bins are generated per group from a one-row-per-group frame (at most 371
cells or ``bins`` rows each) and equi-joined to the aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replaylab.functions import expr as X
from replaylab.operators._common import By, attach_group_stats, by_list, null_safe_join, top_k
from replaylab.operators.metrics import date_range


def year_filter(h: DataFrame, year: int, tz: str | None = None) -> DataFrame:
    """Rows of one calendar year (UTC, or ``tz``), as a half-open ts range.

    The range reaches the scan; on a stored history (it has ``year``) the partition range does too.
    """
    rows = date_range(h, f"{year:04d}-01-01", f"{year + 1:04d}-01-01", slack_days=0 if tz is None else 1)
    return rows if tz is None else rows.where(X.year("ts", tz) == year)


def daily_counts(h: DataFrame, year: int | None = None, by: By = (), tz: str | None = None) -> DataFrame:
    """Streams and ms per calendar day (UTC, or local in ``tz``), with the estimated minutes."""
    by = by_list(by)
    src = year_filter(h, year, tz) if year is not None else h.where(F.col("ts").isNotNull())
    agg = src.groupBy(*by, X.day("ts", tz).alias("day")).agg(
        F.count(F.lit(1)).alias("streams"),
        F.coalesce(F.sum("ms_played"), F.lit(0)).cast("bigint").alias("total_ms"),
    )
    return agg.withColumns({
        "minutes": X.minutes("total_ms"),
        "est_minutes": estimated_minutes(F.col("streams")),
    })


def estimated_minutes(count: Column) -> Column:
    """``round(count * 3.2)`` with half-up rounding."""
    # Fixed value: minutes per stream of the calendar tooltip.
    return F.floor(count * F.lit(3.2) + F.lit(0.5)).cast("bigint")


def calendar_grid(daily: DataFrame, year: int, as_of: str | None = None, by: By = ()) -> DataFrame:
    """Whole-week grid from the Sunday on/before Jan 1 to the Saturday on/after the end.

    The end is Dec 31, or ``as_of`` (default: today) when it falls inside
    ``year``.  Cells outside [Jan 1, end] are padding with count 0.
    """
    by = by_list(by)
    jan1 = F.make_date(F.lit(year), F.lit(1), F.lit(1))
    dec31 = F.make_date(F.lit(year), F.lit(12), F.lit(31))
    a = F.lit(as_of).cast("date") if as_of is not None else X.day(F.current_timestamp())
    end = F.when(F.year(a) == year, F.least(a, dec31)).otherwise(dec31)
    grid_start = F.date_sub(jan1, F.dayofweek(jan1) - 1)
    # One row per group; without keys that is one row, no scan.
    groups = daily.select(*by).distinct() if by else daily.sparkSession.range(1)
    cells = groups.select(
        *by,
        grid_start.alias("grid_start"), jan1.alias("range_start"), end.alias("range_end"),
        F.explode(F.sequence(grid_start, F.date_add(end, 7 - F.dayofweek(end)))).alias("day"),
    )
    counts = daily.select(*by, "day", "streams")
    g = null_safe_join(cells, counts, [*by, "day"], how="left")
    in_range = (F.col("day") >= F.col("range_start")) & (F.col("day") <= F.col("range_end"))
    g = g.select(
        *by, "day",
        F.when(in_range, F.coalesce(F.col("streams"), F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("count"),
        in_range.alias("in_range"),
        F.floor(F.datediff(F.col("day"), F.col("grid_start")) / 7).cast("int").alias("week"),
        (F.dayofweek("day") - 1).alias("dow"),
    )
    g = g.withColumn("level", X.activity_level("count"))
    # A month label on the first in-range week (by its Sunday) of each month.
    sunday = (F.col("dow") == 0) & F.col("in_range")
    w = Window.partitionBy(*[F.col(b) for b in by], sunday).orderBy("day")
    prev = F.lag(F.month("day")).over(w)
    label = F.when(sunday & (prev.isNull() | (prev != F.month("day"))), F.date_format("day", "MMM"))
    return g.withColumn("month_label", label)


def activity_summary(grid: DataFrame, by: By = ()) -> DataFrame:
    """Active days and total streams over in-range cells only."""
    by = by_list(by)
    inr = grid.where(F.col("in_range"))
    return inr.groupBy(*by).agg(
        F.count_if(F.col("count") > 0).cast("bigint").alias("active_days"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total_streams"),
    )


def ts_histogram(h: DataFrame, bins: int = 100, by: By = ()) -> DataFrame:
    """Equal-width histogram of ``ts`` on [min, max], last bin closed.

    Bin of t = floor((t - lo) * bins / (hi - lo)) in exact integer
    microseconds, capped at ``bins - 1``; hi = lo puts everything in bin 0.
    Empty bins are emitted with count 0.
    """
    by = by_list(by)
    us = F.unix_micros("ts")
    dated = h.where(F.col("ts").isNotNull()).select(*by, us.alias("t"))
    bounds = dated.groupBy(*by).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    if not by:
        bounds = bounds.where(F.col("lo").isNotNull())
    span = F.col("hi") - F.col("lo")
    binned = attach_group_stats(dated, bounds, by).select(
        *by,
        F.when(span == 0, F.lit(0)).otherwise(
            F.least(F.lit(bins - 1),
                    F.call_function("div", (F.col("t") - F.col("lo")) * F.lit(bins), span))
        ).cast("int").alias("bin"),
    )
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = bounds.select(
        *by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    out = null_safe_join(grid, counts, [*by, "bin"], how="left")
    start = F.col("lo") + F.call_function("div", F.col("bin").cast("bigint") * (F.col("hi") - F.col("lo")),
                                          F.lit(bins))
    return out.select(
        *by, "bin", start.alias("bin_start_us"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
    )


def streaks_from_days(days: DataFrame, by: By = ()) -> DataFrame:
    """F04 on a frame of distinct active (by, day) rows: gaps and islands."""
    by = by_list(by)
    w = Window.partitionBy(*[F.col(b) for b in by]).orderBy("day")
    island = F.date_sub(F.col("day"), F.row_number().over(w))
    runs = days.select(*by, "day").withColumn("island", island).groupBy(*by, "island").agg(
        F.min("day").alias("start_day"), F.max("day").alias("end_day"),
        F.count(F.lit(1)).alias("length"),
    )
    return runs.drop("island")


def streaks(h: DataFrame, by: By = ()) -> DataFrame:
    """runs of consecutive active days (gaps and islands)."""
    by = by_list(by)
    days = h.where(F.col("ts").isNotNull()).select(*by, X.day("ts").alias("day")).distinct()
    return streaks_from_days(days, by)


def longest_of(runs: DataFrame, by: By = ()) -> DataFrame:
    """the longest run per group (earliest on ties)."""
    by = by_list(by)
    return top_k(runs, by, [F.col("length").desc(), F.col("start_day").asc()], 1).drop("rank")


def longest_streak(h: DataFrame, by: By = ()) -> DataFrame:
    """the longest streak per group (earliest on ties)."""
    return longest_of(streaks(h, by), by)


def weekday_from_days(per_day: DataFrame, by: By = (), ms_col: str = "ms") -> DataFrame:
    """F05 on a (by, day, ms) frame of active days."""
    by = by_list(by)
    return per_day.groupBy(*by, F.dayofweek("day").alias("dow")).agg(
        F.count(F.lit(1)).alias("active_days"),
        F.sum(ms_col).cast("bigint").alias("total_ms"),
        # sum / count / 3.6e6: exact integer sum, then plain IEEE divisions.
        (F.sum(ms_col) / F.count(F.lit(1)) / F.lit(3_600_000.0)).alias("avg_hours"),
    ).withColumn("weekday", F.date_format(F.date_add(F.lit("2023-12-31").cast("date"),
                                                     F.col("dow") - 1), "EEEE"))


def weekday_profile(h: DataFrame, by: By = ()) -> DataFrame:
    """per weekday, active days and the mean listening hours of an active day."""
    by = by_list(by)
    per_day = h.where(F.col("ts").isNotNull()).groupBy(*by, X.day("ts").alias("day")).agg(
        F.coalesce(F.sum("ms_played"), F.lit(0)).cast("bigint").alias("ms")
    )
    return weekday_from_days(per_day, by)


def top_weekday_of(profile: DataFrame, by: By = ()) -> DataFrame:
    """the weekday with the highest mean hours per active day."""
    return top_k(profile, by_list(by), [F.col("avg_hours").desc(), F.col("dow").asc()], 1).drop("rank")


def top_weekday(h: DataFrame, by: By = ()) -> DataFrame:
    """the weekday with the highest mean hours per active day."""
    return top_weekday_of(weekday_profile(h, by), by)


def listening_sessions(h: DataFrame, gap_minutes: int = 30, by: By = ("username",)) -> DataFrame:
    """S04 in batch: gap-based sessions per group, skew-aware.

    A session is a run of plays where each play starts less than ``gap``
    after the previous one; it ends ``gap`` after its last play (the same
    rule as a streaming ``session_window``).

    Phase 1 sessionises inside (group, UTC day) buckets, so one listener's
    plays are spread over many tasks.  Phase 2 merges sessions that continue
    across a bucket boundary with a window over the SESSIONS of a group, whose
    count is bounded by time span / gap, not by data volume.
    """
    by = by_list(by)
    gap = F.lit(gap_minutes * 60_000_000)
    ev = h.where(F.col("ts").isNotNull()).select(*by, F.unix_micros("ts").alias("t"), "ms_played",
                              X.day("ts").alias("bucket"))
    w1 = Window.partitionBy(*[F.col(b) for b in by], "bucket").orderBy("t")
    new1 = F.coalesce((F.col("t") - F.lag("t").over(w1)) >= gap, F.lit(True)).cast("int")
    run1 = F.sum("new1").over(w1.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = (ev.withColumn("new1", new1).withColumn("sid", run1)
            .groupBy(*by, "bucket", "sid")
            .agg(F.min("t").alias("start"), (F.max("t") + gap).alias("end"),
                 F.count(F.lit(1)).alias("plays"),
                 F.coalesce(F.sum("ms_played"), F.lit(0)).cast("bigint").alias("total_ms")))
    w2 = Window.partitionBy(*[F.col(b) for b in by]).orderBy("start")
    new2 = F.coalesce(F.col("start") >= F.lag("end").over(w2), F.lit(True)).cast("int")
    run2 = F.sum("new2").over(w2.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = (part.withColumn("new2", new2).withColumn("gid", run2)
              .groupBy(*by, "gid")
              .agg(F.min("start").alias("start"), F.max("end").alias("end"),
                   F.sum("plays").cast("bigint").alias("plays"),
                   F.sum("total_ms").cast("bigint").alias("total_ms")))
    return merged.select(*by, F.timestamp_micros("start").alias("session_start"),
                         F.timestamp_micros("end").alias("session_end"), "plays", "total_ms")
