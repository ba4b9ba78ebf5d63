"""Skip statistics.

One aggregate per entity, then narrow column arithmetic on the (small)
aggregated frame: binomial tail, Wilson interval, leaderboards.  The global
skip rate is a one-row aggregate attached as a scalar subquery (or joined on
``by`` keys), never broadcast as data that grows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replaylab.functions import expr as X
from replaylab.operators._common import (
    By, attach_group_stats, by_list, key_order, round6, top_k,
)

ARTIST = ("artist_name",)
TRACK_NAME = ("track_name",)
TRACK = ("track_name", "artist_name")


def skip_stats(h: DataFrame, keys: Sequence[str] = ARTIST, by: By = (),
               min_plays: int = 0) -> DataFrame:
    """Plays (non-null ts), skips, skip rate per entity.

    Null entity keys are dropped (as a pandas groupby does).  Skips are
    counted on dated rows only, so skips <= plays always holds.  Rows with
    unknown ``skipped`` stay in the denominator.
    """
    by, keys = by_list(by), list(keys)
    dated = F.col("ts").isNotNull()
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    stats = h.where(cond).groupBy(*by, *keys).agg(
        F.count("ts").alias("total_plays"),
        F.count_if(dated & F.coalesce(F.col("skipped"), F.lit(False))).cast("bigint").alias("skips"),
    )
    stats = stats.withColumn(
        "skip_rate", F.when(F.col("total_plays") > 0, F.col("skips") / F.col("total_plays"))
    )
    if min_plays > 0:
        stats = stats.where(F.col("total_plays") >= min_plays)
    return stats


def global_skip_rate(h: DataFrame, by: By = ()) -> DataFrame:
    """Mean of non-null ``skipped`` over all rows (podcasts included)."""
    by = by_list(by)
    return h.groupBy(*by).agg(F.avg(F.col("skipped").cast("double")).alias("global_rate"))


def with_global_rate(stats: DataFrame, h: DataFrame, by: By = ()) -> DataFrame:
    return attach_group_stats(stats, global_skip_rate(h, by), by_list(by))


def rated_skip_stats(h: DataFrame, keys: Sequence[str] = ARTIST, by: By = (), min_plays: int = 0) -> DataFrame:
    """E02-E04 and E07 from one scan: :func:`skip_stats` with ``global_rate`` on every row.

    One aggregate by entity, null entities included, carries the counts of
    both; the rate is a sum over that same aggregate.  Both branches read the
    same columns of it, so Spark plans its exchange once and reuses it.
    """
    by, keys = by_list(by), list(keys)
    dated, named = F.col("ts").isNotNull(), F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    base = h.groupBy(*by, *keys).agg(
        F.count("ts").alias("total_plays"),
        F.count_if(dated & F.coalesce(F.col("skipped"), F.lit(False))).cast("bigint").alias("skips"),
        F.count_if(F.col("skipped")).alias("__true"),
        F.count("skipped").alias("__known"),
        F.count_if(named).alias("__named"),  # a filter on it stays above the aggregate
    )
    counts = ["total_plays", "skips", "__true", "__known", "__named"]
    sums = base.groupBy(*by).agg(F.struct(*[F.sum(c).alias(c) for c in counts]).alias("__all"))
    rate = F.when(F.col("__all.__known") > 0, F.col("__all.__true") / F.col("__all.__known"))
    out = attach_group_stats(base.where((F.col("__named") > 0) & (F.col("total_plays") >= min_plays)), sums, by)
    return out.select(
        *by, *keys, "total_plays", "skips",
        F.when(F.col("total_plays") > 0, F.col("skips") / F.col("total_plays")).alias("skip_rate"),
        rate.alias("global_rate"),
    )


def skip_surprise(stats: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One-sided binomial test ``P(X >= skips)``, ``X ~ Bin(plays, global_rate)``.

    Needs ``global_rate`` on every row (see :func:`with_global_rate`).
    """
    out = X.with_binom_sf(stats, "skips", "total_plays", "global_rate", out="p_value")
    out = out.withColumn("p_value", F.when(F.col("total_plays") > 0, F.col("p_value")))
    return out.withColumns({
        "neg_log_p": X.neg_log10_p("p_value"),
        "significant": F.col("p_value") < F.lit(alpha),
    })


def wilson(stats: DataFrame, z: float = X.Z_95) -> DataFrame:
    """Wilson interval, whisker lengths, and the robust flag."""
    low, high = X.wilson_bounds("skips", "total_plays", z)
    out = stats.withColumns({"low": low, "high": high})
    out = out.withColumns({
        "err_low": F.greatest(F.col("skip_rate") - F.col("low"), F.lit(0.0)),
        "err_high": F.greatest(F.col("high") - F.col("skip_rate"), F.lit(0.0)),
    })
    if "global_rate" in out.columns:
        out = out.withColumn("robust", F.col("low") > F.col("global_rate"))
    return out


def most_skipped(stats: DataFrame, keys: Sequence[str], n: int | None = None, by: By = ()) -> DataFrame:
    """Entities by descending skip rate (name ascending on ties)."""
    order = [F.col("skip_rate").desc_nulls_last(), *key_order(keys)]
    if n is None:
        return stats.orderBy(*[F.col(b) for b in by_list(by)], *order)
    return top_k(stats, by_list(by), order, n)


def skip_extremes(stats: DataFrame, keys: Sequence[str], n_rate: int = 5, n_plays: int = 4,
                  by: By = ()) -> DataFrame:
    """The top ``n_rate`` by skip rate and top ``n_plays`` by plays, tagged.

    An entity may appear under both tags.
    """
    by, keys = by_list(by), list(keys)
    hot = top_k(stats, by, [F.col("skip_rate").desc_nulls_last(), *key_order(keys)], n_rate)
    fav = top_k(stats, by, [F.col("total_plays").desc(), *key_order(keys)], n_plays)
    cols = [*by, *keys, "total_plays", "skips", "skip_rate", "rank"]
    return hot.select(*cols, F.lit("most_skipped").alias("tag")).unionByName(
        fav.select(*cols, F.lit("most_played").alias("tag"))
    )


def most_surprising(surprise: DataFrame, keys: Sequence[str], n: int = 5, by: By = ()) -> DataFrame:
    """Smallest p-values (clipped at 1e-300), name ascending on ties."""
    order = [F.greatest(F.col("p_value"), F.lit(1e-300)).asc_nulls_last(), *key_order(keys)]
    return top_k(surprise, by_list(by), order, n)


def most_hated(h: DataFrame, keys: Sequence[str] = ARTIST, n: int = 10, min_plays: int = 20,
               by: By = ()) -> DataFrame:
    """Top ``n`` by Wilson lower bound among entities with enough plays.

    ``rank`` 1 is the most robustly skipped; the chart draws them ascending.
    """
    by, keys = by_list(by), list(keys)
    w = wilson(rated_skip_stats(h, keys, by, min_plays=min_plays))
    return top_k(w, by, [F.col("low").desc_nulls_last(), *key_order(keys)], n)


def rounded(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Round float columns to 6 dp (stable values for comparisons)."""
    return df.withColumns({c: round6(F.col(c)) for c in cols})
