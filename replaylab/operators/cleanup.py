"""Table cleanup and inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replaylab.functions import expr as X
from replaylab.sources.export_json import union_parts


def concat_parts(*parts: DataFrame) -> DataFrame:
    """Concatenate export parts by column name (UNION ALL)."""
    return union_parts(parts)


def non_null_counts(df: DataFrame) -> DataFrame:
    """One row: the non-null count of every column (a single aggregate pass)."""
    return df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that hold no value at all.

    One aggregate job decides which columns survive (a one-row result: the
    column list is schema, not data); the returned frame stays lazy.
    """
    counts = non_null_counts(df).first()
    keep = [c for c in df.columns if counts[c] > 0]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def with_minutes(df: DataFrame, ms_col: str = "ms_played", out: str = "minutes_played") -> DataFrame:
    """Duration in minutes, unrounded."""
    return df.withColumn(out, X.raw_minutes(ms_col))


def profile(df: DataFrame) -> DataFrame:
    """Per column its type, non-null count and the table's row count."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count(F.col(f"`{c}`")).alias(f"__nn_{i}") for i, c in enumerate(cols)])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pairs = ", ".join(f"{i}, '{c}', '{types[c]}', `__nn_{i}`" for i, c in enumerate(cols))
    return agg.selectExpr(
        "__rows AS total_rows",
        f"stack({len(cols)}, {pairs}) AS (position, column_name, dtype, non_null)",
    )
