"""Feature matrices: fit statistics and vocabularies, then transform each row without a shuffle."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import let, to_double
from cairn.operators.describe import build_vocab
from cairn.operators.ranks import long_numbers, order_stats


@dataclass(frozen=True)
class Scale:
    """clip: the 99th percentile or None; mean, std, median of the transformed values; log: log1p after clipping."""

    clip: float | None
    mean: float
    std: float
    median: float
    log: bool = True


def _raw(c: str, clip: Column | float | None, log: bool) -> Column:
    x = to_double(c)
    x = F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))) if log else x
    if clip is not None:
        x = F.when(x.isNotNull(), F.least(x, F.lit(clip) if isinstance(clip, float) else clip))
    return F.log1p(x) if log else x


def fit_scaler(df: DataFrame, logs: Sequence[str], plain: Sequence[str] = ()) -> dict[str, Scale]:
    """A46. `logs`: negatives to 0, clipped at the 99th percentile, log1p. Mean, std (n) and median of each; std under 1e-8 becomes 1; a field
    without values gets 0 and 1. Flooring, clipping and log1p keep the order of values, so both quantiles come from the same places."""
    stats = {r.field: r.stats for r in order_stats(long_numbers(df, [*logs, *plain]), ["field"], [0.99, 0.5]).collect()}  # a row a field
    at = lambda s, f: f(s.lo) + (f(s.hi) - f(s.lo)) * s.part
    clips = {c: at(stats[c][0], lambda v: max(v, 0.0)) if c in stats else None for c in logs}
    medians = {c: at(s[1], (lambda v, c=c: log1p(min(max(v, 0.0), clips[c]))) if c in logs else (lambda v: v)) for c, s in stats.items()}
    aggs = []
    for c in (*logs, *plain):
        x = _raw(c, clips.get(c), c in logs)
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_pop(x).alias(f"{c}__std")]
    row = df.agg(*aggs).first()
    out = {}
    for c in (*logs, *plain):
        mean, std, median = row[f"{c}__mean"], row[f"{c}__std"], medians.get(c)
        out[c] = Scale(clips.get(c), mean or 0.0, std if std is not None and std >= 1e-8 else 1.0, median or 0.0, c in logs)
    return out


def scaled(c: str, s: Scale) -> Column:
    """Missing values become the median, then z-score."""
    return (F.coalesce(_raw(c, s.clip, s.log), F.lit(s.median)) - s.mean) / s.std


def vocabulary(df: DataFrame, scalars: Sequence[str], lists: Sequence[str] = ()) -> dict[str, list[str]]:
    """A7 as lists on the driver. They have as many tokens as the vectors that are made from them have places."""
    rows = build_vocab(df, scalars, lists).orderBy("field", "index_in_block").collect()
    out: dict[str, list[str]] = {f: [] for f in (*scalars, *lists)}
    for r in rows:
        out[r.field].append(r.token)
    return out


def _places(tokens: Sequence[str]) -> Column:
    """Token -> its place, as one literal that is parsed once, whatever the number of tokens."""
    return F.from_json(F.lit(json.dumps({t: i for i, t in enumerate(tokens)})), "map<string,int>")


def one_hot(c: str, tokens: Sequence[str]) -> Column:
    """An unknown or missing value counts as the first token, 'unknown'."""
    at = F.coalesce(_places(tokens)[F.col(c)], F.lit(0))
    return let(at, lambda i: F.transform(F.sequence(F.lit(0), F.lit(len(tokens) - 1)), lambda k: (k == i).cast("float")))


def multi_hot(c: str, tokens: Sequence[str]) -> Column:
    """Unknown values are ignored."""
    values = F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: _places(tokens)[v])
    return let(values, lambda at: F.transform(F.sequence(F.lit(0), F.lit(len(tokens) - 1)), lambda k: F.coalesce(F.array_contains(at, k), F.lit(False)).cast("float")))


def feature_matrix(df: DataFrame, key: str, scaler: Mapping[str, Scale], vocab: Mapping[str, Sequence[str]], lists: Sequence[str] = (),
                   flags: Mapping[str, Column] | None = None, layout: str = "full", version: str = "1") -> DataFrame:
    """A47. (key, vector array<float>, dim, version), for vocabularies that fit a driver's lists; sparse_features takes any. Layouts: 'flags' (numbers and flags), 'full' (numbers, flags, one-hot, multi-hot),
    'reduced' (numbers and one-hot)."""
    parts = [F.array(*[scaled(c, s).cast("float") for c, s in scaler.items()])] if scaler else []
    if layout in ("flags", "full") and flags:
        parts.append(F.array(*[f.cast("float") for f in flags.values()]))
    if layout in ("full", "reduced"):
        parts += [one_hot(f, t) for f, t in vocab.items() if f not in lists]
    if layout == "full":
        parts += [multi_hot(f, t) for f, t in vocab.items() if f in lists]
    vector = F.concat(*parts)
    return df.select(key, vector.alias("vector")).select(key, "vector", F.size("vector").alias("dim"), F.lit(version).alias("version"))


def feature_index(df: DataFrame, scaler: Mapping[str, Scale], vocab: Mapping[str, Sequence[str]], lists: Sequence[str] = (), flags: Sequence[str] = (),
                  layout: str = "full") -> DataFrame:
    """A48. (index, kind, field, value) of the vector that feature_matrix builds."""
    rows = [("numeric", f, "log1p z-score" if s.log else "z-score") for f, s in scaler.items()]
    if layout in ("flags", "full"):
        rows += [("flag", f, "") for f in flags]
    if layout in ("full", "reduced"):
        rows += [("one_hot", f, t) for f, ts in vocab.items() if f not in lists for t in ts]
    if layout == "full":
        rows += [("multi_hot", f, t) for f, ts in vocab.items() if f in lists for t in ts]
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "index int, kind string, field string, value string")


def scaler_table(df: DataFrame, scaler: Mapping[str, Scale]) -> DataFrame:
    """A48. (field, transform, mean, std, median, clip)."""
    rows = [(f, "log1p" if s.log else "none", s.mean, s.std, s.median, s.clip) for f, s in scaler.items()]
    return df.sparkSession.createDataFrame(rows, "field string, transform string, mean double, std double, median double, clip double")


def _tokens(df: DataFrame, keep: Sequence[str], scalars: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """(keep, field, token): a row for each known scalar and each distinct item of a list."""
    cells = [F.struct(F.lit(f).alias("field"), F.array_compact(F.array(F.col(f"`{f}`").cast("string"))).alias("tokens")) for f in scalars]
    cells += [F.struct(F.lit(f).alias("field"), F.array_distinct(F.col(f"`{f}`").cast("array<string>")).alias("tokens")) for f in lists]
    return df.select(*keep, F.inline(F.array(*cells))).select(*keep, "field", F.explode("tokens").alias("token"))


def sparse_features(df: DataFrame, key: str, scaler: Mapping[str, Scale], vocab: DataFrame, scalars: Sequence[str], lists: Sequence[str] = (),
                    flags: Mapping[str, Column] | None = None, layout: str = "full", version: str = "1") -> DataFrame:
    """A47. The vector of feature_matrix as (key, dim, indices array<long>, values array<float>, version): numbers always, flags, one-hot and
    multi-hot places where they are one, by ascending index. vocab is a table (field, token, index_in_block) of any size, as build_vocab
    makes it: tokens find their places by a join, and the driver learns one number a field. key is unique."""
    flags = (flags or {}) if layout in ("flags", "full") else {}
    scalars = scalars if layout in ("full", "reduced") else []
    lists = lists if layout == "full" else []
    sizes = {r.field: r.n for r in vocab.groupBy("field").agg((F.max("index_in_block") + 1).alias("n")).collect()}  # a row a field
    begins, at = {}, len(scaler) + len(flags)
    for f in (*scalars, *lists):
        begins[f], at = at, at + sizes.get(f, 1)
    dim = at
    place = lambda i, value: F.struct(i.cast("long").alias("index"), value.cast("float").alias("value"))
    dense = [place(F.lit(i), scaled(c, s)) for i, (c, s) in enumerate(scaler.items())]
    dense += [F.when(f.cast("float") != 0, place(F.lit(len(scaler) + i), f)) for i, f in enumerate(flags.values())]
    own = df.select(key, F.array_compact(F.array(*dense)).alias("_own") if dense else F.array().cast("array<struct<index:bigint,value:float>>").alias("_own"))
    if not begins:
        whole = own
    else:
        found = _tokens(df, [key], scalars, lists).join(vocab.select("field", "token", "index_in_block"), ["field", "token"])
        begin = F.element_at(F.create_map(*[F.lit(x) for pair in begins.items() for x in pair]), F.col("field"))
        # a scalar without a place counts as unknown, the first of its block
        known = found.groupBy(key).agg(F.sort_array(F.collect_list(begin + F.col("index_in_block"))).alias("_at"))
        t = own.join(known, key, "left").withColumn("_at", F.coalesce("_at", F.array().cast("array<int>")))
        inside = lambda first, last: F.exists("_at", lambda i: i.between(first, last))
        missing = [F.when(~inside(begins[f], begins[f] + sizes.get(f, 1) - 1), F.lit(begins[f])) for f in scalars]
        ones = F.array_sort(F.concat("_at", F.array_compact(F.array(*missing)))) if missing else F.col("_at")
        whole = t.select(key, F.concat("_own", F.transform(ones, lambda i: place(i, F.lit(1.0)))).alias("_own"))
    return whole.select(key, F.lit(dim).alias("dim"), F.col("_own.index").alias("indices"), F.col("_own.value").alias("values"), F.lit(version).alias("version"))


def unknown_counts(df: DataFrame, vocab: DataFrame | Mapping[str, Sequence[str]], lists: Sequence[str] = (), scalars: Sequence[str] | None = None) -> DataFrame:
    """A48. (field, unknown): values that the vocabulary doesn't have, those of a list once per row. vocab: a table (field, token) of any size
    with the names of its scalar fields, or lists by field. Equal values are counted before they are held against it."""
    spark = df.sparkSession
    if isinstance(vocab, Mapping):
        scalars = [f for f in vocab if f not in lists]
        vocab = spark.createDataFrame([(f, t) for f, tokens in vocab.items() for t in tokens], "field string, token string")
    counts = _tokens(df, [], scalars or [], lists).groupBy("field", "token").agg(F.count("*").alias("n"))
    gone = counts.join(vocab, ["field", "token"], "left_anti").groupBy("field").agg(F.sum("n").alias("unknown"))
    fields = spark.createDataFrame([(f,) for f in (*(scalars or []), *lists)], "field string")
    return fields.join(gone, "field", "left").select("field", F.coalesce("unknown", F.lit(0).cast("long")).alias("unknown"))
