"""Descriptive statistics. Numeric operators make one aggregate over all columns; rows are never moved whole."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.scalars import is_missing, to_double
from cairn.operators.ranks import long_numbers, numbered, quantiles


def _unpivot(row: DataFrame, cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """A wide row of '<col>__<name>' -> one row a column: field and the names."""
    cells = [F.struct(F.lit(c).alias("field"), *[F.col(f"`{c}__{n}`").alias(n) for n in names]) for c in cols]
    return row.select(F.inline(F.array(*cells)))


def _wide(df: DataFrame, cols: Sequence[str], stats: Mapping[str, object]) -> DataFrame:
    aggs = [f(to_double(c)).alias(f"{c}__{n}") for c in cols for n, f in stats.items()]
    return _unpivot(df.agg(*aggs), cols, list(stats))


def missing_by_field(df: DataFrame) -> DataFrame:
    """A1. field, total, missing, missing_rate; rate null on an empty table."""
    aggs = [F.count_if(is_missing(F.col(f"`{f.name}`"), f.dataType)).alias(f"{f.name}__missing") for f in df.schema]
    row = df.agg(F.count("*").alias("total"), *aggs)
    cells = [F.struct(F.lit(c).alias("field"), "total", F.col(f"`{c}__missing`").alias("missing")) for c in df.columns]
    return row.select(F.inline(F.array(*cells))).withColumn("missing_rate", F.try_divide("missing", "total"))


def missing_cells(df: DataFrame, key: str) -> DataFrame:
    """A1. (key, field) of each missing cell."""
    cells = [F.when(is_missing(F.col(f"`{f.name}`"), f.dataType), F.lit(f.name)) for f in df.schema if f.name != key]
    return df.select(key, F.explode(F.array_compact(F.array(*cells))).alias("field"))


def numeric_summary(df: DataFrame, cols: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """A2. field, count, mean, std (n - 1), min, p25, p50, p75, max. Quartiles are exact, or, with an accuracy, approximate."""
    t = _wide(df, cols, {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    q = quantiles(long_numbers(df, cols), ["field"], [0.25, 0.5, 0.75], accuracy)
    parts = [F.get("q", i).alias(name) for i, name in enumerate(("p25", "p50", "p75"))]
    return t.join(q, "field", "left").select("field", "count", "mean", "std", "min", *parts, "max")


def variance_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A3. Fields from the least to the most varied: mean, std (n - 1), min, max, n."""
    return _wide(df, cols, {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "n": F.count}).orderBy("std", "field")


def long_values(df: DataFrame, fields: Sequence[str], keep: Sequence[str | Column] = ()) -> DataFrame:
    """field, value (as text) for each column: one pass instead of one a field."""
    cells = [F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields]
    return df.select(*keep, F.inline(F.array(*cells)))


def value_counts(df: DataFrame, fields: Sequence[str], missing: str = "drop") -> DataFrame:
    """A4. (field, value, n). missing: 'drop' leaves out null and blank values, 'text' counts null as the text 'None'."""
    values = long_values(df, fields)
    if missing == "drop":
        values = values.filter(F.trim("value") != "")
    elif missing == "text":
        values = values.withColumn("value", F.coalesce("value", F.lit("None")))
    else:
        raise ValueError("missing is 'drop' or 'text'")
    return values.groupBy("field", "value").agg(F.count("*").alias("n"))


def multilabel_counts(df: DataFrame, fields: Sequence[str], per_entity: bool = False) -> DataFrame:
    """A5. (field, value, n) of list columns: every occurrence, or each value once per row."""
    cells = [F.struct(F.lit(f).alias("field"), (F.array_distinct(F.col(f"`{f}`")) if per_entity else F.col(f"`{f}`")).alias("values")) for f in fields]
    exploded = df.select(F.inline(F.array(*cells))).select("field", F.explode("values").alias("value"))
    return exploded.filter(F.trim("value") != "").groupBy("field", "value").agg(F.count("*").alias("n"))


def token_counts(df: DataFrame, dataset: str, scalars: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """A6. (dataset, field, value, n); null counts as __MISSING__, an empty list as __EMPTY__, list values once per row."""
    gone, empty = F.array(F.lit("__MISSING__")), F.array(F.lit("__EMPTY__"))
    cells = [F.struct(F.lit(f).alias("field"), F.when(F.col(f"`{f}`").isNull(), gone).otherwise(F.array(F.col(f"`{f}`").cast("string"))).alias("values")) for f in scalars]
    cells += [
        F.struct(
            F.lit(f).alias("field"),
            F.when(F.col(f"`{f}`").isNull(), gone).when(F.size(f"`{f}`") == 0, empty).otherwise(F.array_distinct(f"`{f}`")).alias("values"),
        )
        for f in lists
    ]
    long = df.select(dataset, F.inline(F.array(*cells))).select(dataset, "field", F.explode("values").alias("value"))
    return long.groupBy(dataset, "field", "value").agg(F.count("*").alias("n"))


def build_vocab(df: DataFrame, scalars: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """A7. (field, token, index_in_block): 'unknown' at 0, then the tokens in order from 1. Tokens are numbered by ranges, so a field may have
    very many."""
    cells = [F.struct(F.lit(f).alias("field"), F.array(F.col(f"`{f}`").cast("string")).alias("values")) for f in scalars]
    cells += [F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("values")) for f in lists]
    tokens = df.select(F.inline(F.array(*cells))).select("field", F.explode("values").alias("token"))
    tokens = tokens.filter((F.trim("token") != "") & (F.col("token") != "unknown")).distinct()
    tokens = numbered(tokens, ["field"], [F.col("token")], "_at")
    unknown = df.sparkSession.createDataFrame([(f, "unknown", 0) for f in (*scalars, *lists)], "field string, token string, index_in_block int")
    return tokens.select("field", "token", (F.col("_at") + 1).cast("int").alias("index_in_block")).unionByName(unknown)


def box_stats(df: DataFrame, cat: str, num: str, order: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """A17. Per category: n, quartiles and whiskers (the outermost values within 1.5 IQR of the quartiles). With an order only those
    categories, with their position."""
    x = df.select(F.col(cat).alias("category"), to_double(num).alias("x")).filter("category is not null and x is not null")
    if order is not None:
        at = F.array_position(F.array(*map(F.lit, order)), F.col("category"))
        x = x.withColumn("position", at.cast("int")).filter("position > 0")
    keys = ["category", *(["position"] if order is not None else [])]
    q = x.groupBy(*keys).agg(F.count("*").alias("n")).join(quantiles(x, ["category"], [0.25, 0.5, 0.75], accuracy), "category")
    q = q.select(*keys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    inside = x.join(q.select("category", "q1", "q3"), "category").filter(F.col("x").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr))
    ends = inside.groupBy("category").agg(F.min("x").alias("whisker_low"), F.max("x").alias("whisker_high"))
    return q.join(ends, "category")


def ingest_summary(good: DataFrame, bad: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A49. (name, value): documents_total, ok, bad and the missing rate of each numeric column."""
    rates = [F.try_divide(F.count_if(to_double(c).isNull()), F.count("*")).alias(f"{c}__r") for c in cols]
    row = good.agg(F.count("*").alias("ok"), *rates).crossJoin(bad.agg(F.count("*").alias("bad")))  # two single rows
    value = lambda name, c: F.struct(F.lit(name).alias("name"), c.cast("double").alias("value"))
    cells = [value("documents_total", F.col("ok") + F.col("bad")), value("documents_ok", F.col("ok")), value("documents_bad", F.col("bad"))]
    return row.select(F.inline(F.array(*cells, *[value(f"missing_rate.{c}", F.col(f"`{c}__r`")) for c in cols])))


def ingest(raw: DataFrame, ok: Column, cols: Sequence[str], path: str) -> DataFrame:
    """A49 while the good rows of raw, those for which ok holds, are written to path as Parquet: the summary's counts are observed on the way,
    so raw is read once."""
    good = F.coalesce(ok, F.lit(False))
    seen = Observation()
    metrics = [F.count("*").alias("total"), F.count_if(good).alias("ok"), *[F.count_if(good & to_double(c).isNull()).alias(f"gone_{i}") for i, c in enumerate(cols)]]
    raw.observe(seen, *metrics).filter(good).write.parquet(path)
    m = seen.get
    rate = lambda n: n / m["ok"] if m["ok"] else None
    rows = [("documents_total", float(m["total"])), ("documents_ok", float(m["ok"])), ("documents_bad", float(m["total"] - m["ok"]))]
    rows += [(f"missing_rate.{c}", rate(m[f"gone_{i}"])) for i, c in enumerate(cols)]
    return raw.sparkSession.createDataFrame(rows, "name string, value double")


def top_outliers(df: DataFrame, key: Sequence[str], cols: Sequence[str], n: int = 50) -> DataFrame:
    """T1. The n rows of each field farthest from its mean: key, field, x, z, rank. Constant fields give none; ties go by key."""
    stats = _wide(df, cols, {"mean": F.avg, "std": F.stddev_samp}).filter("std > 0")
    cells = [F.struct(F.lit(c).alias("field"), to_double(c).alias("x")) for c in cols]
    long = df.select(*key, F.inline(F.array(*cells))).filter("x is not null")
    # the statistics are one row a field; Spark ranks within tasks first (a limit under the window), so no task holds a field
    scored = long.join(F.broadcast(stats), "field").withColumn("z", (F.col("x") - F.col("mean")) / F.col("std"))
    rank = F.row_number().over(W.partitionBy("field").orderBy(F.desc(F.round(F.abs("z"), 9)), *key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n).select(*key, "field", "x", "z", "rank")
