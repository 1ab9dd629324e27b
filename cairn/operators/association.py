"""Association between fields, and with a label."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import to_double
from cairn.functions.stats import guarded_corr
from cairn.operators.ranks import numbered, running, with_totals


def contingency(df: DataFrame, label: str, scalars: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """A8. (field, value, label0, label1): rows of each value by a 0/1 label. List items count as often as they occur; blank values and
    null labels are left out."""
    cells = [F.struct(F.lit(f).alias("field"), F.array(F.col(f"`{f}`").cast("string")).alias("values")) for f in scalars]
    cells += [F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("array<string>").alias("values")) for f in lists]
    long = df.filter(F.col(label).isin(0, 1)).select(F.col(label).alias("_y"), F.inline(F.array(*cells)))
    long = long.select("_y", "field", F.explode("values").alias("value")).filter(F.trim("value") != "")
    return long.groupBy("field", "value").agg(F.count_if(F.col("_y") == 0).alias("label0"), F.count_if(F.col("_y") == 1).alias("label1"))


def chi_square(table: DataFrame) -> DataFrame:
    """A9. From a contingency: field, chi2, dof, n_categories, ordered by chi2. Yates' correction at one degree of freedom, as in the
    usual libraries. Fields with fewer than two values or an empty label column are left out."""
    t = with_totals(table, ["field"], n0=F.sum("label0"), n1=F.sum("label1"), k=F.count("*").cast("int"))
    t = t.filter((F.col("k") >= 2) & (F.col("n0") > 0) & (F.col("n1") > 0)).withColumn("row", F.col("label0") + F.col("label1"))

    def part(seen: str, total: str):
        expected = F.col("row") * F.col(total) / (F.col("n0") + F.col("n1"))
        gap = F.abs(F.col(seen) - expected)
        gap = F.when(F.col("k") == 2, F.greatest(gap - F.least(gap, F.lit(0.5)), F.lit(0.0))).otherwise(gap)
        return gap * gap / expected

    out = t.groupBy("field").agg(
        F.sum(part("label0", "n0") + part("label1", "n1")).alias("chi2"),
        (F.max("k") - 1).alias("dof"),
        F.max("k").alias("n_categories"),
    )
    return out.orderBy(F.desc("chi2"), "field")


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """A10. One row: v, chi2 (no correction), n, r, k; v is null when either side has one value. Empty cells count: their expected
    value is part of the sum, taken from the margins without listing them."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    margin = lambda side: cells.groupBy(side).agg(F.sum("n").alias(f"n{side}"))
    t = cells.join(margin("a"), "a").join(margin("b"), "b")
    # sum of (o - e)^2 / e over all cells is n (sum of o^2 / (row x column) - 1), which empty cells don't change
    row = t.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n") / (F.col("na").cast("double") * F.col("nb"))).alias("s"),
        F.count_distinct("a").alias("r"),
        F.count_distinct("b").alias("k"),
    )
    chi2 = F.col("n") * (F.col("s") - 1)
    low = F.least("r", "k") - 1
    return row.select(
        F.when(low > 0, F.sqrt(F.greatest(chi2, F.lit(0.0)) / (F.col("n") * low))).alias("v"), chi2.alias("chi2"), "n", "r", "k"
    )


def point_biserial(df: DataFrame, cols: Sequence[str], label: str, least: int = 10) -> DataFrame:
    """A11. field, r, n: correlation with a 0/1 label; fields with fewer than `least` rows are left out, constant ones get null."""
    y = F.col(label).cast("double")
    cells = [
        F.struct(
            F.lit(c).alias("field"),
            guarded_corr(to_double(c), y, 1e-8).alias("r"),
            F.count(F.when(y.isNotNull(), to_double(c))).alias("n"),
        )
        for c in cols
    ]
    return df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells")).filter(F.col("n") >= least)


def spearman(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """A12. field, rho, n: rank correlation with a numeric label, ties averaged. Ranks come from the running counts of distinct values."""
    cells = [F.struct(F.lit(c).alias("field"), to_double(c).alias("x"), F.col(label).cast("double").alias("y")) for c in cols]
    counts = df.select(F.inline(F.array(*cells))).filter("x is not null and y is not null").groupBy("field", "x", "y").agg(F.count("*").alias("n"))

    def ranks(side: str) -> DataFrame:
        one = running(counts.groupBy("field", side).agg(F.sum("n").alias("m")), ["field"], side, ["m"])
        return one.select("field", side, (F.col("m_upto") - (F.col("m") - 1) / 2).alias(f"r{side}"))

    t = counts.join(ranks("x"), ["field", "x"]).join(ranks("y"), ["field", "y"])
    n, w = F.sum("n"), F.col("n")
    mean = lambda c: F.sum(w * c) / n
    rx, ry = F.col("rx"), F.col("ry")
    moments = t.groupBy("field").agg(
        n.alias("n"), mean(rx).alias("mx"), mean(ry).alias("my"), mean(rx * rx).alias("xx"), mean(ry * ry).alias("yy"), mean(rx * ry).alias("xy")
    )
    vx, vy = F.col("xx") - F.col("mx") * F.col("mx"), F.col("yy") - F.col("my") * F.col("my")
    rho = F.when((vx > 0) & (vy > 0), (F.col("xy") - F.col("mx") * F.col("my")) / F.nullif(F.sqrt(vx * vy), F.lit(0.0)))
    return moments.select("field", rho.alias("rho"), "n")


def pearson_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A13. (a, b, r) for each pair of columns in the given order, over rows where both are known; one aggregate."""
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), guarded_corr(to_double(a), to_double(b)).alias("r"))
        for i, a in enumerate(cols)
        for b in cols[i + 1 :]
    ]
    return df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))


def binary_features(df: DataFrame, key: str, scalars: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """A14. Sparse 0/1 design: a row (key, feature) for each one, feature = 'field=value'."""
    cells = [F.array(F.concat(F.lit(f"{f}="), F.col(f"`{f}`").cast("string"))) for f in scalars]
    named = lambda f: F.transform(F.col(f"`{f}`"), lambda v: F.concat(F.lit(f"{f}="), v))
    cells += [named(f) for f in lists]
    every = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in cells]))
    return df.select(key, F.explode(F.array_distinct(F.array_compact(every))).alias("feature"))


def binary_pair_corr(features: DataFrame, key: str, n: int, k: int = 100, fields: Sequence[str] = ()) -> DataFrame:
    """A15. The k feature pairs with the largest |phi|: a, b, phi, abs_r. n is the number of entities. Features that all or no entities
    have are left out. Equal ones go by the order of columns: by the field's place in `fields` ('field=value' names the field),
    then by name.

    Pairs that meet come from each entity's own list of features. |phi| of pairs that never meet grows with how common either is, so by
    places in the order of commonness a pair comes after all pairs of earlier or equal places. Only features before which fewer than k
    unmet pairs are complete can be the commoner side of one of the k: so many that most of their pairs meet, the root of twice the
    number of meetings. Each needs its first k unmet partners, so there are as many candidates as meetings, and k for each such feature."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, fields)), F.substring_index("feature", "=", 1)), F.lit(0)) if fields else F.lit(0)
    one = features.groupBy("feature").agg(F.count("*").alias("m")).filter(F.col("m") < n)
    one = one.select(F.struct(place.cast("long").alias("at"), F.col("feature")).alias("f"), "m")
    own = features.select(key, F.struct(place.cast("long").alias("at"), F.col("feature")).alias("f"))
    lists = own.groupBy(key).agg(F.array_sort(F.collect_set("f")).alias("f"))
    pairs = F.flatten(F.transform("f", lambda a, i: F.transform(F.filter("f", lambda _, j: j > i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    met = lists.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("nab"))
    side = lambda name: one.select(F.col("f").alias(name), F.col("m").alias(f"n{name}"))
    met = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "nab")

    def phi_of(t: DataFrame) -> DataFrame:
        na, nb, nab = (F.col(c).cast("double") for c in ("na", "nb", "nab"))
        phi = (n * nab - na * nb) / F.sqrt(na * (n - na) * nb * (n - nb))
        t = t.withColumns({"phi": phi, "abs_r": F.abs(phi)}).orderBy(F.desc(F.round(F.log("abs_r"), 10)), "a", "b").limit(k)
        return t.select(F.col("a.feature").alias("a"), F.col("b.feature").alias("b"), "phi", "abs_r")

    ranked = numbered(one.select("f", "m", (-F.col("m")).alias("_less")), [], [F.col("_less"), F.col("f")], "place").select("f", "m", "place")
    at = lambda side, number: ranked.select(F.col("f").alias(side), F.col("place").alias(number))
    places = met.select("a", "b").join(at("a", "i"), "a").join(at("b", "j"), "b").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    # i (i + 1) / 2 pairs are complete before place i as a commoner side; `shared` of them meet at the most
    shared = lists.agg(F.sum(F.size("f").cast("long") * (F.size("f") - 1) / 2)).first()[0] or 0
    heads = isqrt(2 * (int(shared) + k)) + 1
    near = places.filter(F.col("i") <= heads).groupBy("i").agg(F.count("*").alias("met"))
    first = features.sparkSession.range(heads + 1).withColumnRenamed("id", "i").join(near, "i", "left")
    ahead = first.select("i", F.explode(F.sequence(F.col("i") + 1, F.col("i") + k + F.coalesce("met", F.lit(0)))).alias("j"))
    unmet = ahead.join(places, ["i", "j"], "left_anti")
    side = lambda number, name: ranked.select(F.col("place").alias(number), F.col("f").alias(name), F.col("m").alias(f"n{name}"))
    unmet = unmet.join(side("i", "x"), "i").join(side("j", "y"), "j")
    turned = F.col("x") > F.col("y")
    swap = lambda one, two, name: F.when(turned, F.col(two)).otherwise(F.col(one)).alias(name)
    unmet = unmet.select(swap("x", "y", "a"), swap("y", "x", "b"), swap("nx", "ny", "na"), swap("ny", "nx", "nb"), F.lit(0).cast("long").alias("nab"))
    return phi_of(met.unionByName(unmet))


def top_std_corr(features: DataFrame, key: str, n: int, top: int = 40, fields: Sequence[str] = ()) -> DataFrame:
    """A15. The same among the `top` features with the highest standard deviation (shares nearest one half; ties by name)."""
    share = F.col("m") / n
    best = features.groupBy("feature").agg(F.count("*").alias("m")).orderBy(F.desc(share * (1 - share)), "feature").limit(top)
    return binary_pair_corr(features.join(F.broadcast(best), "feature", "left_semi"), key, n, top * top, fields)


def linear_fit(df: DataFrame, x: str, y: str, least: int = 5) -> DataFrame:
    """A16. One row: slope, intercept, r, n; nulls below `least` rows or for a constant x."""
    a, b = to_double(x), to_double(y)
    row = df.agg(
        F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), guarded_corr(a, b).alias("r"), F.regr_count(b, a).alias("n")
    )
    return row.select(*[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("slope", "intercept", "r")], "n")


