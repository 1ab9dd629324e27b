"""Joins and keyed selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.ranks import with_totals


def join_labels(ann: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """K1. Inner equi-join; Spark broadcasts the labels if their measured size allows."""
    return ann.join(labels, key, "inner")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """K2. The first row of each key in a stated order. A minimum over a struct combines on the map side, so a hot key's rows
    never meet in one task. Null order values come first."""
    keys = list(key)
    rank = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[r.alias(f"o{i}") for i, r in enumerate(rank)])).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def join_predictions(base: DataFrame, other: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """K3. Two prediction tables and features, always by id: base and other have (key, label, pred); the label is base's."""
    left = base.select(key, "label", F.col("pred").alias("pred_base"))
    right = other.select(key, F.col("pred").alias("pred_new"))
    return left.join(right, key).join(features, key)


def filter_split(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """K4."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def attach_features(df: DataFrame, features: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """K5. A left join; rows without a vector get zeros."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return df.join(features.select(key, vector), key, "left").withColumn(vector, F.coalesce(vector, zeros))


def pending_items(items: DataFrame, done: DataFrame, key: str, valid: Column) -> DataFrame:
    """K6. Items without a valid finished output."""
    return items.join(done.filter(valid).select(key).distinct(), key, "left_anti")


def reconcile(items: DataFrame, outputs: DataFrame, key: str, valid: Column) -> DataFrame:
    """K7. One row of counts. An invalid orphan counts twice among anomalies, as an invalid output and as an orphan."""
    have = outputs.groupBy(key).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("bad"))
    both = items.select(key).distinct().withColumn("_item", F.lit(1)).join(have, key, "full_outer")
    item, out = F.col("_item").isNotNull(), F.col("n").isNotNull()
    counts = both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("outputs"),
        F.count_if(item & out).alias("matched"),
        F.count_if(item & ~out).alias("unprocessed"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid"),
        F.count_if(~item & out).alias("orphan"),
    )
    return counts.withColumn("anomalies", F.col("invalid") + F.col("orphan")).withColumn(
        "estimate", F.col("unprocessed") + F.col("anomalies")
    )


def failures(items: DataFrame, outputs: DataFrame, key: str, valid: Column) -> DataFrame:
    """K7. (key, reason) of each output that is invalid or has no item; both reasons give two rows."""
    known = outputs.join(items.select(key).distinct().withColumn("_item", F.lit(1)), key, "left")
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce(valid, F.lit(False)), "invalid"),
            F.when(F.col("_item").isNull(), "orphan"),
        )
    )
    return known.select(key, F.explode(reasons).alias("reason"))


def failure_report(failed: DataFrame) -> DataFrame:
    """K7. (reason, n) of failures, and a row with reason 'total'."""
    return failed.groupBy("reason").agg(F.count("*").alias("n")).unionByName(failed.agg(F.lit("total").alias("reason"), F.count("*").alias("n")))


def output_detail(outputs: DataFrame, path: str, modified: str, valid: Column) -> DataFrame:
    """K7. A row for each output file: file (its name), path, modified (ISO time to the second), is_empty (not valid: no bytes, unreadable
    or without what must be filled in). Sort by path to number the rows."""
    return outputs.select(
        F.element_at(F.split(F.col(path), "/"), -1).alias("file"), F.col(path).alias("path"),
        F.coalesce(F.date_format(F.col(modified), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("modified"),
        F.when(F.coalesce(valid, F.lit(False)), "NO").otherwise("YES").alias("is_empty"),
    )


def align_counts(counts: DataFrame, dataset: str, ref: str, tgt: str) -> DataFrame:
    """K8. counts: (dataset, field, value, n). One row per field and value of either dataset: ref_n, tgt_n, zero-filled."""
    return counts.groupBy("field", "value").agg(
        F.sum(F.when(F.col(dataset) == ref, F.col("n")).otherwise(0)).alias("ref_n"),
        F.sum(F.when(F.col(dataset) == tgt, F.col("n")).otherwise(0)).alias("tgt_n"),
    )


def exclusive_values(aligned: DataFrame, tokens: Sequence[str] = ("__MISSING__", "__EMPTY__")) -> DataFrame:
    """K9. Values of one side only: (side, field, value, n, share of the side's field). Tokens don't count as values."""
    shares = with_totals(aligned, ["field"], ref_all=F.sum("ref_n"), tgt_all=F.sum("tgt_n"))
    only = shares.filter(((F.col("ref_n") == 0) != (F.col("tgt_n") == 0)) & ~F.col("value").isin(*tokens))
    is_ref = F.col("tgt_n") == 0
    return only.select(
        F.when(is_ref, "ref").otherwise("tgt").alias("side"),
        "field",
        "value",
        F.when(is_ref, F.col("ref_n")).otherwise(F.col("tgt_n")).alias("n"),
        F.when(is_ref, F.col("ref_n") / F.col("ref_all")).otherwise(F.col("tgt_n") / F.col("tgt_all")).alias("share"),
    )
