"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: distinct (u, v) with u > v. The least neighbour is aggregated first, so a hub's rows meet in no task."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = stored(around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    near = around.join(least, "u")
    if large:
        return near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a, b): links between long identifiers, in any order, repeats and a = b allowed. Returns one row per linked
    identifier and its root, the smallest identifier that it reaches: (node, root); roots themselves have no row."""
    edges = stored(
        links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = _state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        edges = stored(_star(stored(_star(edges, True), "large"), False), "small")
        if (after := _state(edges)) == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
