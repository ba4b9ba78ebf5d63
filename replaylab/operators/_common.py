"""Helpers shared by the operators: grouping keys, top-k, null-safe joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

By = Sequence[str]


def by_list(by: By | str | None) -> list[str]:
    if by is None:
        return []
    if isinstance(by, str):
        return [by]
    return list(by)


def key_order(keys: Sequence[str]) -> list[Column]:
    """Final tie-break: entity keys ascending, nulls last."""
    return [F.col(k).asc_nulls_last() for k in keys]


def top_k(df: DataFrame, by: By, order: Sequence[Column], n: int,
          rank_col: str = "rank") -> DataFrame:
    """Top ``n`` rows per ``by`` group, numbered 1..n in ``rank_col``.

    ``row_number() <= n`` is planned as a ``WindowGroupLimit``: each map task
    keeps its own top ``n`` per group before the shuffle, so a hot group never
    ships more than ``n`` rows per task.
    """
    if n < 1:
        raise ValueError("n must be >= 1")
    w = Window.partitionBy(*[F.col(b) for b in by]).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` where NULL matches NULL (``<=>``).

    Catalyst extracts ``<=>`` as an equi-join key, so this still plans as a
    hash/sort-merge (or size-checked broadcast) join, never a nested loop.
    """
    on = list(on)
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c)
                             for c in right.columns])
    cond = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    joined = left.join(renamed, on=cond, how=how)
    if how in ("left_semi", "left_anti", "semi", "anti", "leftsemi", "leftanti"):
        return joined
    return joined.drop(*[f"__r_{c}" for c in on])


def attach_group_stats(df: DataFrame, stats: DataFrame, by: By) -> DataFrame:
    """Attach per-``by`` statistics (one row per group) to every row of ``df``.

    With grouping keys this is an equi-join on them (NULL is a group too).  Without keys ``stats`` is
    a global aggregate (exactly one row) and is attached as scalar subqueries,
    which Spark evaluates once and inlines: no join at all.
    """
    by = list(by)
    if by:
        return null_safe_join(df, stats, by, how="left")
    cols = [c for c in stats.columns]
    packed = stats.select(F.struct(*cols).alias("s")).scalar()
    return df.select("*", *[packed[c].alias(c) for c in cols])


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared checkpoint folder and read it back.

    Used for small intermediate results that several branches of one plan
    consume, so the fact table behind them is scanned once.  The folder is
    the session's ``spark.checkpoint.dir`` (a scratch folder only when unset).
    """
    from replaylab.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def round6(c: Column) -> Column:
    return F.round(c, 6)
