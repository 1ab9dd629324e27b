"""Running totals and exact quantiles of large groups, without a task that holds a whole group.

Values are counted first. The distinct values of a group are then dealt by value to ranges, as many as their number asks for
(bounds from an approximate percentile of bounded size; where they lie affects balance only), totals run inside each range,
and what the ranges before it hold is added: so no window is longer than a range, and quantiles are read off the running
counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.scalars import to_double

#: Distinct values in a range, ranges of a group at the most, and the accuracy of their bounds.
A_RANGE, PARTS, ACCURACY = 100_000, 1024, 4096


def below(bounds: Column, x: Column, parts: int) -> Column:
    """How many of up to `parts` ascending bounds are below x, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(parts.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(bounds, at + step - 1) < x, step).otherwise(0))


def ranges(counts: DataFrame, by: Sequence[str], x: str, a_range: int = A_RANGE, parts: int = PARTS) -> DataFrame:
    """(by, _bounds): ascending bounds of the ranges of a group's rows by x, about a_range rows each, no more than `parts` ranges. A group of up
    to a_range rows has one range."""
    at = [i / parts for i in range(1, parts)]
    t = counts.groupBy(*by).agg(F.percentile_approx(x, at, ACCURACY).alias("_bounds"), F.count("*").alias("_rows"))
    every = F.greatest(F.floor(parts / F.ceil(F.col("_rows") / a_range)), F.lit(1))  # of the finest bounds, each `every`-th is one
    return t.select(*by, F.array_distinct(F.filter("_bounds", lambda _, i: (i + 1) % every == 0)).alias("_bounds"))


def running(counts: DataFrame, by: Sequence[str], x: str, sums: Sequence[str], a_range: int = A_RANGE, parts: int = PARTS) -> DataFrame:
    """counts: one row for each (by, x), x a known number. Adds, for each column s of sums, s_upto (total of rows up to this one) and
    s_all (total of the group), and x_next, the next larger x (null for the last)."""
    by = list(by)
    t = counts.join(ranges(counts, by, x, a_range, parts), by).withColumn("_range", below(F.col("_bounds"), F.col(x), parts)).drop("_bounds")
    here = t.groupBy(*by, "_range").agg(F.min(x).alias("_first"), *[F.sum(s).alias(f"_{s}") for s in sums])
    order, whole = W.partitionBy(*by).orderBy("_range"), W.partitionBy(*by)  # at most `parts` rows a group
    here = here.select(
        *by, "_range", F.lead("_first").over(order).alias("_then"),
        *[F.coalesce(F.sum(f"_{s}").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_{s}_before") for s in sums],
        *[F.sum(f"_{s}").over(whole).alias(f"{s}_all") for s in sums],
    )
    inner = W.partitionBy(*by, "_range").orderBy(x)
    out = t.withColumns({"x_next": F.lead(x).over(inner), **{f"{s}_upto": F.sum(s).over(inner) for s in sums}}).join(here, [*by, "_range"])
    out = out.withColumns({"x_next": F.coalesce("x_next", "_then"), **{f"{s}_upto": F.col(f"{s}_upto") + F.col(f"_{s}_before") for s in sums}})
    return out.drop("_range", "_then", *[f"_{s}_before" for s in sums])


def with_totals(rows: DataFrame, by: Sequence[str], **totals: Column) -> DataFrame:
    """rows with totals of their group `by`, which has few members such as fields and datasets: one row a group, made of partial sums and
    broadcast, so that the rows of a large group needn't meet."""
    return rows.join(F.broadcast(rows.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])), list(by))


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "number", bounds: int = 255) -> DataFrame:
    """Adds `name`, from 0: the place of a row inside its group `by`, in an order that leaves no ties. The rows with the least hashes, a
    sample that depends on nothing but the rows, cut each group into ranges of the order; places are counted inside the ranges, and
    what the ranges before hold is added. `bounds` limits the sample; where its members lie affects balance only."""
    by = list(by)
    t = rows.withColumn("_key", F.struct(*[F.col(c) for c in by], *order))
    few = t.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(bounds).orderBy("_key")
    cuts = [r[0] for r in few.select(F.to_json(F.struct("_key"))).collect()]  # at most `bounds` rows
    kind = t.schema["_key"].dataType.simpleString()
    cuts = F.from_json(F.lit(f"[{','.join(cuts)}]"), f"array<struct<_key:{kind}>>")["_key"]
    t = t.withColumn("_range", below(cuts, F.col("_key"), bounds))
    sizes = t.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # at most bounds + 1 rows a group
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    here = F.row_number().over(W.partitionBy(*by, "_range").orderBy("_key"))
    return t.withColumn("_here", here).join(sizes, [*by, "_range"]).withColumn(name, F.col("_before") + F.col("_here") - 1).drop("_key", "_range", "_here", "_before")


def long_numbers(df: DataFrame, cols: Sequence[str], keep: Sequence[str | Column] = ()) -> DataFrame:
    """(keep, field, x): a row for each row and column; x is null where it isn't a number."""
    cells = [F.struct(F.lit(c).alias("field"), to_double(c).alias("x")) for c in cols]
    return df.select(*keep, F.inline(F.array(*cells)))


def order_stats(long: DataFrame, by: Sequence[str], at: Sequence[float]) -> DataFrame:
    """(by, stats): for each share of `at` a struct (lo, hi, part): the values around its place among the known x of a group, from 0 to
    n - 1, and how far between them it lies. Any monotone change of x may be made on lo and hi."""
    counts = long.filter("x is not null").groupBy(*by, "x").agg(F.count("*").alias("n"))
    t = running(counts, by, "x", ["n"])
    before = F.col("n_upto") - F.col("n")

    def stat(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("n_all") - 1)
        value = lambda k: F.max(F.when((before <= k) & (k < F.col("n_upto")), F.col("x")))
        return F.struct(value(F.floor(place)).alias("lo"), value(F.ceil(place)).alias("hi"), F.max(place - F.floor(place)).alias("part"))

    return t.groupBy(*by).agg(F.array(*map(stat, at)).alias("stats"))


def between(s: Column) -> Column:
    """The interpolated quantile of a struct of order_stats."""
    return s["lo"] + (s["hi"] - s["lo"]) * s["part"]


def quantiles(long: DataFrame, by: Sequence[str], at: Sequence[float], accuracy: int | None = None) -> DataFrame:
    """(by, q): quantiles of x, exact and interpolated as usual, or, with an accuracy, approximate ones by a sketch of bounded size (one
    shuffle less; each is a value that occurs)."""
    if accuracy is not None:
        return long.groupBy(*by).agg(F.percentile_approx("x", list(map(float, at)), accuracy).alias("q")).filter("q is not null")
    return order_stats(long, by, at).select(*by, F.transform("stats", between).alias("q"))
