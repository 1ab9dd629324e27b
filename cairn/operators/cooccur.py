"""Co-occurrence of tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tag_rows(df: DataFrame, key: str, tags: str) -> DataFrame:
    """(key, tag), each tag once per entity."""
    return df.select(key, F.explode(F.array_distinct(tags)).alias("tag")).filter(F.trim("tag") != "")


def with_family(rows: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """A18. Adds the tag's family from a fixed dictionary; tags of none are left out."""
    pairs = [F.lit(x) for family, tags in families.items() for t in tags for x in (t, family)]
    return rows.withColumn("family", F.element_at(F.create_map(*pairs), F.col("tag"))).filter("family is not null")


def tag_families(rows: DataFrame) -> DataFrame:
    """A18. (family, tag, n, rank): entities with the tag, ordered inside the family. rows: distinct (key, tag, family)."""
    counts = rows.groupBy("family", "tag").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("family").orderBy(F.desc("n"), "tag")))


def _pairs(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b, n) with a <= b, from each entity's own sorted list: one shuffle, no self-join."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.filter("x", lambda _, j: j >= i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def family_cooccurrence(rows: DataFrame, key: str) -> DataFrame:
    """A19. (a, b, n): entities with both families, a <= b, the diagonal included."""
    return _pairs(rows, key, "family")


def pair_stats(rows: DataFrame, key: str, family: str | None = None, top_k: int = 40) -> DataFrame:
    """A20. (a, b, co, pa, pb): entities with both tags and with each, a <= b; the tags of a family, or the top_k of all."""
    if family is not None:
        rows = rows.filter(F.col("family") == family)
    presence = rows.groupBy("tag").agg(F.count("*").alias("p"))
    if family is None:
        presence = presence.orderBy(F.desc("p"), "tag").limit(top_k)
        rows = rows.join(F.broadcast(presence.select("tag")), "tag", "left_semi")  # at most top_k rows
    pairs = _pairs(rows, key, "tag").withColumnRenamed("n", "co")
    a = presence.select(F.col("tag").alias("a"), F.col("p").alias("pa"))
    b = presence.select(F.col("tag").alias("b"), F.col("p").alias("pb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "co", "pa", "pb")


def pair_metric(pairs: DataFrame, metric: str) -> DataFrame:
    """A21. Adds value: 'count', 'jaccard' or 'pmi'. For PMI the total is the largest presence or joint count; undefined is 0."""
    if metric == "count":
        return pairs.withColumn("value", F.col("co").cast("double"))
    if metric == "jaccard":
        both = F.col("pa") + F.col("pb") - F.col("co")
        return pairs.withColumn("value", F.when(both > 0, F.col("co") / F.nullif(both, F.lit(0))).otherwise(0.0))
    if metric != "pmi":
        raise ValueError("metric is 'count', 'jaccard' or 'pmi'")
    total = pairs.agg(F.greatest(F.max("pa"), F.max("pb"), F.max("co"), F.lit(1)).alias("_n"))
    value = F.log(F.col("co") * F.col("_n") / (F.col("pa") * F.col("pb")))
    return pairs.crossJoin(F.broadcast(total)).withColumn("value", F.when(F.col("co") > 0, value).otherwise(0.0)).drop("_n")  # one row
