"""Drift between two datasets, on long rows (dataset, field, x) or on counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.scalars import to_double
from cairn.functions.stats import bins_below
from cairn.operators import ranks

QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
TINY = 1e-6


def long_numbers(df: DataFrame, dataset: str | Column, cols: Sequence[str]) -> DataFrame:
    """(dataset, field, x); x is null where missing."""
    name = F.col(dataset) if isinstance(dataset, str) else dataset
    return ranks.long_numbers(df, cols, [name.alias("dataset")])


def infer_kinds(long: DataFrame, share: float = 0.95) -> DataFrame:
    """A22. long: (field, value text, is_list, is_dict). field, kind: all_missing, categorical_multilabel, mixed_skip, numeric_scalar (at
    least `share` of the known values are numbers) or categorical_scalar."""
    known = F.count("value")
    numbers = F.count(to_double("value"))
    return long.groupBy("field").agg(
        F.when(known == 0, "all_missing")
        .when(F.max("is_list"), "categorical_multilabel")
        .when(F.max("is_dict"), "mixed_skip")
        .when(numbers >= share * known, "numeric_scalar")
        .otherwise("categorical_scalar")
        .alias("kind")
    )


def two_sample_summary(long: DataFrame, least: int = 50, sides: int = 2, accuracy: int | None = None, totals: Mapping[str, int] | None = None) -> DataFrame:
    """A23. A row for each field and dataset: missing_rate, n, mean, std (n), min, quantiles, max; fields with fewer than `least` values
    on any of the `sides`, or that a side lacks altogether, are left out. totals has the number of documents of each dataset, where
    documents without a field have no row."""
    q = ranks.quantiles(long, ["field", "dataset"], list(QUANTILES.values()), accuracy)
    every = F.count("*")
    if totals:
        every = F.element_at(F.create_map(*[F.lit(x) for pair in totals.items() for x in pair]), F.col("dataset"))
    t = long.groupBy("field", "dataset").agg(
        (1 - F.count("x") / every).alias("missing_rate"),
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
    )
    by = W.partitionBy("field")  # a row for each side
    t = t.withColumns({"_least": F.min("n").over(by), "_sides": F.count("*").over(by)}).filter((F.col("_least") >= least) & (F.col("_sides") >= sides))
    t = t.join(q, ["field", "dataset"], "left")
    return t.select("field", "dataset", "missing_rate", "n", "mean", "std", "min", *[F.get("q", i).alias(p) for i, p in enumerate(QUANTILES)], "max")


def psi_bins(long: DataFrame, ref: str, tgt: str, bins: int = 10) -> DataFrame:
    """A24. (field, bin, ref_share, tgt_share, term). Both sides are clipped to the reference's 1st and 99th percentile (widened by 0.5 if
    they are equal), bins are left-closed between unique quantiles of the reference, shares are at least TINY."""
    x = long.filter("x is not null")
    # clipping keeps the order of values, so the quantiles of the clipped side follow from those of the side itself
    at = [0.01, 0.99, *(i / bins for i in range(bins + 1))]
    stats = ranks.order_stats(x.filter(F.col("dataset") == ref), ["field"], at)
    low, high = ranks.between(F.get("stats", 0)), ranks.between(F.get("stats", 1))
    wide = F.when(low == high, 0.5).otherwise(0.0)
    stats = stats.select("field", F.slice("stats", 3, bins + 1).alias("stats"), (low - wide).alias("lo"), (high + wide).alias("hi"))
    clip = lambda v: F.least(F.greatest(v, F.col("lo")), F.col("hi"))
    point = lambda s: clip(s["lo"]) + (clip(s["hi"]) - clip(s["lo"])) * s["part"]
    edges = stats.select("field", "lo", "hi", F.array_sort(F.array_distinct(F.transform("stats", point))).alias("e"))
    edges = edges.select("field", "lo", "hi", F.when(F.size("e") > 1, F.col("e")).otherwise(F.array("lo", "hi")).alias("e"))
    clipped = x.join(F.broadcast(edges.select("field", "lo", "hi")), "field").withColumn("x", clip(F.col("x")))  # one row a field
    inner = edges.select("field", F.slice("e", 2, F.size("e") - 2).alias("inner"), (F.size("e") - 1).alias("k"))
    counts = (
        clipped.join(F.broadcast(inner), "field")
        .groupBy("field", bins_below(F.col("inner"), F.col("x"), strict=False).alias("bin"))
        .agg(F.count_if(F.col("dataset") == ref).alias("r"), F.count_if(F.col("dataset") == tgt).alias("t"))
    )
    all_bins = inner.select("field", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    return _psi_terms(all_bins.join(counts, ["field", "bin"], "left").fillna(0, ["r", "t"]), "bin")


def _psi_terms(counts: DataFrame, item: str) -> DataFrame:
    t = ranks.with_totals(counts, ["field"], r_all=F.sum("r"), t_all=F.sum("t"))
    p = F.greatest(F.col("r") / F.greatest("r_all", F.lit(1)), F.lit(TINY))
    q = F.greatest(F.col("t") / F.greatest("t_all", F.lit(1)), F.lit(TINY))
    shares = t.select("field", item, p.alias("ref_share"), q.alias("tgt_share"))
    return shares.withColumn("term", (F.col("ref_share") - F.col("tgt_share")) * F.log(F.col("ref_share") / F.col("tgt_share")))


def psi_numeric(long: DataFrame, ref: str, tgt: str, bins: int = 10) -> DataFrame:
    return psi_bins(long, ref, tgt, bins).groupBy("field").agg(F.sum("term").alias("psi"))


def psi_categorical(aligned: DataFrame) -> DataFrame:
    """A25. aligned: (field, value, ref_n, tgt_n) with tokens. (field, psi)."""
    terms = _psi_terms(aligned.select("field", "value", F.col("ref_n").alias("r"), F.col("tgt_n").alias("t")), "value")
    return terms.groupBy("field").agg(F.sum("term").alias("psi"))


def cumulative(long: DataFrame, ref: str, tgt: str) -> DataFrame:
    """(field, x, x_next, f_ref, f_tgt): both distribution functions at each distinct value, and the next value."""
    counts = long.filter("x is not null").groupBy("field", "x").agg(
        F.count_if(F.col("dataset") == ref).alias("r"), F.count_if(F.col("dataset") == tgt).alias("t")
    )
    share = lambda s: F.try_divide(f"{s}_upto", F.nullif(F.col(f"{s}_all"), F.lit(0)))
    return ranks.running(counts, ["field"], "x", ["r", "t"]).select("field", "x", "x_next", share("r").alias("f_ref"), share("t").alias("f_tgt"))


def ks_2samp(long: DataFrame, ref: str, tgt: str) -> DataFrame:
    """A26. (field, ks)."""
    return cumulative(long, ref, tgt).groupBy("field").agg(F.max(F.abs(F.col("f_ref") - F.col("f_tgt"))).alias("ks"))


def wasserstein(long: DataFrame, ref: str, tgt: str) -> DataFrame:
    """A27. (field, wasserstein)."""
    t = cumulative(long, ref, tgt).withColumn("step", F.col("x_next") - F.col("x"))
    return t.groupBy("field").agg(F.coalesce(F.sum(F.abs(F.col("f_ref") - F.col("f_tgt")) * F.col("step")), F.lit(0.0)).alias("wasserstein"))


def shift_rank(numeric: DataFrame, categorical: DataFrame) -> DataFrame:
    """A28. (rank, field, kind, psi) of all fields, largest first. One row a field."""
    both = numeric.select("field", F.lit("numeric").alias("kind"), "psi").unionByName(categorical.select("field", F.lit("categorical").alias("kind"), "psi"))
    return both.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("psi", 9)), "field"))).orderBy("rank")


def enum_shares(counts: DataFrame, dataset: str = "dataset") -> DataFrame:
    """A29. Adds share: of the counts inside (dataset, field)."""
    t = ranks.with_totals(counts, [dataset, "field"], _all=F.sum("n"))
    return t.select(*counts.columns, (F.col("n") / F.col("_all")).alias("share"))


def lump_other(aligned: DataFrame, k: int, forced: Sequence[str] | None = None, cap: int = 60) -> DataFrame:
    """A30. (field, value, ref_n, tgt_n): the k commonest values, values of one side only (or the forced ones), at most `cap` of these by
    count, and OTHER for the rest. Spark takes the first rows of a field in each task before it merges them (a limit under the
    window); the rest is what the field's totals leave."""
    by_count = W.partitionBy("field").orderBy(F.desc(F.col("ref_n") + F.col("tgt_n")), "value")
    first = lambda t, n: t.withColumn("_place", F.row_number().over(by_count)).filter(F.col("_place") <= n).drop("_place")
    one_side = (F.col("ref_n") == 0) | (F.col("tgt_n") == 0) if forced is None else F.col("value").isin(*forced)
    t = aligned.select("field", "value", "ref_n", "tgt_n")
    # at most k + cap rows a field from here on
    kept = first(first(t, min(k, cap)).unionByName(first(t.filter(one_side), cap)).distinct(), cap)
    sums = lambda d, sign: d.groupBy("field").agg(F.count("*").alias("rows"), F.sum("ref_n").alias("ref_n"), F.sum("tgt_n").alias("tgt_n")).withColumn("sign", F.lit(sign))
    rest = sums(t, 1).unionByName(sums(kept, -1)).groupBy("field").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in ("rows", "ref_n", "tgt_n")])
    other = rest.filter("rows > 0").select("field", F.lit("OTHER").alias("value"), "ref_n", "tgt_n")
    return kept.unionByName(other).groupBy("field", "value").agg(F.sum("ref_n").alias("ref_n"), F.sum("tgt_n").alias("tgt_n"))


def histogram(long: DataFrame, edges: Sequence[float]) -> DataFrame:
    """A31. (dataset, field, bin, n, density): left-closed bins, the last one closed; values outside are left out. Every bin has a row;
    the density is null if a field has no values inside."""
    e = list(map(float, edges))
    inside = lambda i: (F.col("x") >= e[i]) & ((F.col("x") < e[i + 1]) if i < len(e) - 2 else (F.col("x") <= e[i + 1]))
    counts = long.groupBy("dataset", "field").agg(F.array(*[F.count_if(inside(i)) for i in range(len(e) - 1)]).alias("_n"))
    total = F.aggregate("_n", F.lit(0).cast("long"), lambda a, n: a + n)
    t = counts.select("dataset", "field", total.alias("_all"), F.posexplode("_n").alias("bin", "n"))
    width = F.get(F.array(*[F.lit(b - a) for a, b in zip(e, e[1:], strict=False)]), F.col("bin"))
    return t.select("dataset", "field", "bin", "n", (F.try_divide("n", "_all") / width).alias("density"))


def ecdf(long: DataFrame) -> DataFrame:
    """A31. (dataset, field, x, share): share of values up to each distinct value."""
    counts = long.filter("x is not null").groupBy("dataset", "field", "x").agg(F.count("*").alias("n"))
    t = ranks.running(counts, ["dataset", "field"], "x", ["n"])
    return t.select("dataset", "field", "x", (F.col("n_upto") / F.col("n_all")).alias("share"))
