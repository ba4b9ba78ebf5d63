"""Connected components by alternating star contractions, as Spark joins (any diameter in few rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from replaylab.llm._common import stored


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    """For each node ``u`` of (u, v) rows its smallest neighbour; map-side minima first, so hubs are cheap."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest_neighbour(down)
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the (u, v) long edges; root is the smallest node of its component.

    Roots hang on themselves.  Self loops, repeated edges, either direction and an empty table are
    fine; rows with a null end are no edges.  Each round is written to the shared folder.  Only a
    row count and a checksum of the edges reach the driver.
    """
    now = stored(edges.select("u", "v").where("u is not null and v is not null and u != v").distinct(), name)

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()

    before = mark(now)
    while before[0]:
        now = stored(_small_star(_large_star(now)), name)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
