"""Error slices: where a new model errs more or less than a base model. Rows have label, pred_base, pred_new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import to_double, wrong_flag
from cairn.functions.stats import bins_below
from cairn.operators.ranks import long_numbers, quantiles


def with_errors(df: DataFrame, label: str, base: str, new: str) -> DataFrame:
    return df.withColumns({"err_base": wrong_flag(base, label), "err_new": wrong_flag(new, label)})


def _table(df: DataFrame, *keys) -> DataFrame:
    t = df.groupBy(*keys).agg(F.count("*").alias("support"), F.avg("err_base").alias("base_error_rate"), F.avg("err_new").alias("new_error_rate"))
    return t.withColumn("delta_error", F.col("new_error_rate") - F.col("base_error_rate"))


def slice_error(df: DataFrame, slice_: Column | str) -> DataFrame:
    """A35. (slice, support, base_error_rate, new_error_rate, delta_error); null slices are left out."""
    c = F.col(slice_) if isinstance(slice_, str) else slice_
    return _table(df.withColumn("slice", c.cast("string")).filter("slice is not null"), "slice")


def quantile_edges(df: DataFrame, cols: Sequence[str], q: int, accuracy: int | None = None) -> DataFrame:
    """(field, edges): quantile edges of each column with known values, one row a field; exact, or, with an accuracy, approximate."""
    return quantiles(long_numbers(df, cols), ["field"], [i / q for i in range(q + 1)], accuracy).withColumnRenamed("q", "edges")


def qcut(df: DataFrame, col: str, q: int, labels: Sequence[str] | None = None, out: str = "bin") -> DataFrame:
    """A36. Adds `out`: the right-closed quantile bin from 0 (or its label); the first bin takes the minimum. Equal edges: without labels
    they are dropped, with labels the bins are of equal width instead (A37)."""
    edges = quantile_edges(df, [col], q).agg(F.array_sort(F.array_distinct(F.any_value("edges"))).alias("_e"))  # one row
    if labels is not None:
        if edges.filter(F.size("_e") <= q).isEmpty() is False:
            return cut(df, col, q, labels, out)
    x = to_double(col)
    number = F.least(F.greatest(bins_below(F.col("_e"), x) - 1, F.lit(0)), F.size("_e") - 2)
    number = F.when(x.isNotNull(), F.greatest(number, F.lit(0)))
    value = number if labels is None else F.get(F.array(*map(F.lit, labels)), number)
    return df.crossJoin(F.broadcast(edges)).withColumn(out, value).drop("_e")  # one row


def cut(df: DataFrame, col: str, bins: int, labels: Sequence[str] | None = None, out: str = "bin") -> DataFrame:
    """A37. Adds `out`: the right-closed bin of equal width from 0 (or its label); the first bin takes the minimum. A constant column falls
    into the middle bin, the lower one of two, as if its range were widened on both sides."""
    x = to_double(col)
    ends = F.broadcast(df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")))
    place = F.ceil((x - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins) - 1
    inside = F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    number = F.when(x.isNotNull(), F.when(F.col("_lo") == F.col("_hi"), (bins + 1) // 2 - 1).otherwise(inside))
    value = number if labels is None else F.get(F.array(*map(F.lit, labels)), number)
    return df.crossJoin(ends).withColumn(out, value).drop("_lo", "_hi")  # one row


def all_bins(table: DataFrame, labels: Sequence[str]) -> DataFrame:
    """A37. Slices that no row falls into get a row with support 0."""
    every = table.sparkSession.createDataFrame([(x,) for x in labels], "slice string")
    return every.join(table, "slice", "left").fillna(0, ["support"])


def slice_all_features(df: DataFrame, categories: Sequence[str], numbers: Sequence[str], q: int = 4) -> DataFrame:
    """A38. (feature, slice_value, ...) for every feature in one shuffle: categories as they are, numbers by quartile bins from 0.
    Constant and unknown features are left out."""
    edges = {}
    if numbers:  # one row a field, read by the driver to fold the edges into the plan as constants
        rows = quantile_edges(df, numbers, q).collect()
        edges = {r.field: sorted(set(r.edges)) for r in rows if r.edges[0] < r.edges[-1]}
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("slice_value")) for c in categories]
    for c, e in edges.items():
        x = to_double(c)
        number = F.least(F.greatest(bins_below(F.array(*map(F.lit, e)), x) - 1, F.lit(0)), F.lit(len(e) - 2))
        cells.append(F.struct(F.lit(c).alias("feature"), F.when(x.isNotNull(), number).cast("string").alias("slice_value")))
    long = df.select("err_base", "err_new", F.inline(F.array(*cells))).filter("slice_value is not null")
    t = _table(long, "feature", "slice_value")
    varied = t.groupBy("feature").agg(F.count("*").alias("k")).filter("k > 1")
    return t.join(varied, "feature", "left_semi")


def rank_slices(slices: DataFrame, k: int = 10, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """A39. (the k most improved, the k most regressed) slices with a support of at least `least`; ties go by feature and value."""
    good = slices.filter(F.col("support") >= least)
    d = F.round("delta_error", 9)
    return (
        good.filter(d < 0).orderBy(d, "feature", "slice_value").limit(k),
        good.filter(d > 0).orderBy(F.desc(d), "feature", "slice_value").limit(k),
    )


def least_changed(slices: DataFrame, least: int = 50) -> DataFrame:
    """A39. The slice whose error changes least."""
    d = F.round(F.abs("delta_error"), 9)
    return slices.filter(F.col("support") >= least).orderBy(d, "feature", "slice_value").limit(1)
