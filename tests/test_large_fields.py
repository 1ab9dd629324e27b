"""Operators on one field with very many values, and pairs of very many features."""

import random
from itertools import combinations
from math import sqrt

import pytest
from pyspark.sql import functions as F

from cairn.operators import association as A
from cairn.operators import describe as D
from cairn.operators import drift as R
from cairn.operators import keys as K
from cairn.operators import ranks


def brute_pairs(rows, n, k):
    own = {}
    for e, f in rows:
        own.setdefault(f, set()).add(e)
    own = {f: s for f, s in own.items() if len(s) < n}
    out = []
    for a, b in combinations(sorted(own), 2):
        na, nb, nab = len(own[a]), len(own[b]), len(own[a] & own[b])
        out.append((-round(abs((n * nab - na * nb) / sqrt(na * (n - na) * nb * (n - nb))), 9), a, b))
    return sorted(out)[:k]


@pytest.mark.parametrize("seed", range(4))
def test_pairs_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    n, names = 40, [f"f{i:02}" for i in range(25)]
    # few large features that all meet, many that never do, and ties
    rows = [(e, f) for f in names[:5] for e in rng.sample(range(n), rng.choice([20, 20, 30]))] + [(e, f) for f in names[5:] for e in rng.sample(range(n), rng.choice([1, 1, 2, 3]))]
    df = spark.createDataFrame(rows, "k long, feature string")
    for k in (1, 7, 60, 1000):
        got = [(-round(r.abs_r, 9), r.a, r.b) for r in A.binary_pair_corr(df, "k", n, k).collect()]
        assert got == brute_pairs(rows, n, k)


def test_pairs_of_features_that_occur_once(spark):
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("k"), F.format_string("f%06d", "id").alias("feature"))
    got = [(r.a, r.b) for r in A.binary_pair_corr(df, "k", n, 20).collect()]
    assert got == [("f000000", f"f{i:06}") for i in range(1, 21)]


@pytest.fixture(scope="module")
def wide(spark):
    """Counts of a field of 300,000 values, which partly one side has alone, and of a small one."""
    big = spark.range(0, 300_000, 1, 8).select(F.lit("big").alias("field"), F.concat(F.lit("v"), "id").alias("value"), (F.col("id") % 3).alias("ref_n"), ((F.col("id") + 1) % 4).alias("tgt_n"))
    small = spark.createDataFrame([("small", "a", 5, 5), ("small", "OTHER", 4, 0), ("small", "b", 1, 1), ("small", "c", 1, 2)], "field string, value string, ref_n long, tgt_n long")
    return big.filter("ref_n + tgt_n > 0").unionByName(small)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_window_holds_a_field(wide):
    shares = wide.select(F.lit("x").alias("dataset"), "field", "value", F.col("ref_n").alias("n"))
    for df in (R.psi_categorical(wide), R.enum_shares(shares), K.exclusive_values(wide), A.chi_square(wide.toDF("field", "value", "label0", "label1"))):
        assert "Window" not in plan_of(df)


def test_shares_and_psi_of_a_large_field(wide):
    rows = [r.asDict() for r in wide.collect()]
    total = {f: (sum(r["ref_n"] for r in rows if r["field"] == f), sum(r["tgt_n"] for r in rows if r["field"] == f)) for f in ("big", "small")}
    only = {(r.side, r.field, r.value): (r.n, round(r.share, 12)) for r in K.exclusive_values(wide).collect()}
    assert len(only) == sum((r["ref_n"] == 0) != (r["tgt_n"] == 0) for r in rows)
    assert only["ref", "small", "OTHER"] == (4, round(4 / 11, 12))
    assert only["ref", "big", "v7"] == (1, round(1 / total["big"][0], 12))
    shares = R.enum_shares(wide.select(F.lit("x").alias("dataset"), "field", "value", F.col("ref_n").alias("n")))
    assert shares.columns == ["dataset", "field", "value", "n", "share"]
    assert {r.field: round(r.s, 9) for r in shares.groupBy("field").agg(F.sum("share").alias("s")).collect()} == {"big": 1.0, "small": 1.0}


@pytest.mark.parametrize(("k", "cap", "forced"), [(2, 3, None), (5, 60, None), (3, 60, ["b", "v17"]), (9, 2, None)])
def test_other_of_a_large_field(wide, k, cap, forced):
    got = {(r.field, r.value): (r.ref_n, r.tgt_n) for r in R.lump_other(wide, k, forced, cap).collect()}
    want = {}
    for f in ("big", "small"):
        rows = sorted(((r.value, r.ref_n, r.tgt_n) for r in wide.filter(F.col("field") == f).collect()), key=lambda r: (-r[1] - r[2], r[0]))
        shown = [r for i, r in enumerate(rows) if i < k or (r[0] in forced if forced is not None else (r[1] == 0) != (r[2] == 0))][:cap]
        for value, a, b in rows:
            key = (f, value if (value, a, b) in set(shown) else "OTHER") if f == "small" or len(rows) < 10 else (f, "OTHER")
            if f == "small":
                x, y = want.get(key, (0, 0))
                want[key] = (x + a, y + b)
        if f == "big":
            kept = {v for v, _, _ in shown}
            for v, a, b in shown:
                want[f, v] = (a, b)
            want[f, "OTHER"] = (sum(a for v, a, _ in rows if v not in kept), sum(b for v, _, b in rows if v not in kept))
    assert got == want


def test_places_of_a_large_field(spark):
    rows = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 100 == 0, "small").otherwise("big").alias("field"), F.hex(F.col("id") * 7919 % 200_003).alias("token"))
    for bounds in (1, 31):
        got = ranks.numbered(rows, ["field"], [F.col("token")], "no", bounds).collect()
        for f in ("small", "big"):
            own = sorted((r.no, r.token) for r in got if r.field == f)
            assert [no for no, _ in own] == list(range(len(own))) and [t for _, t in own] == sorted(t for _, t in own)
    assert ranks.numbered(rows.limit(0), ["field"], [F.col("token")]).count() == 0


def test_vocabulary_of_a_large_field(spark):
    rows = spark.range(0, 100_000, 1, 8).select(F.format_string("t%06d", F.col("id") % 50_000).alias("c"), F.array(F.lit("b"), F.lit("a"), F.lit("unknown"), F.lit(" ")).alias("l"))
    vocab = D.build_vocab(rows, ["c"], ["l"])
    assert "row_number" not in plan_of(vocab) or "_range" in plan_of(vocab)
    got = {(r.field, r.token): r.index_in_block for r in vocab.collect()}
    assert len(got) == 50_001 + 3 and got["c", "unknown"] == got["l", "unknown"] == 0 and (got["l", "a"], got["l", "b"]) == (1, 2)
    assert all(got["c", f"t{i:06}"] == i + 1 for i in range(50_000))


def test_sparse_features_are_the_dense_ones(spark):
    from cairn.operators import features as X

    rows = [(1, 1.0, "a", ["x", "x"]), (2, None, "b", None), (3, -5.0, "zz", ["y", "q"]), (4, 2.0, None, []), (5, 2.0, "unknown", ["unknown"])]
    df = spark.createDataFrame(rows, "id int, n double, c string, l array<string>")
    seen = df.filter("id < 3 or id = 4").withColumn("l", F.array(F.lit("x"), F.lit("y")))
    vocab, scaler = D.build_vocab(seen, ["c"], ["l"]), X.fit_scaler(df, ["n"])
    lists = X.vocabulary(seen, ["c"], ["l"])
    flags = {"big": F.col("id") > 2, "never": F.lit(False)}
    for layout in ("full", "reduced", "flags"):
        dense = {r.id: r for r in X.feature_matrix(df, "id", scaler, lists, ["l"], flags, layout).collect()}
        for r in X.sparse_features(df, "id", scaler, vocab, ["c"], ["l"], flags, layout).collect():
            vector = [0.0] * r.dim
            for i, v in zip(r.indices, r["values"], strict=True):
                vector[i] = v
            assert r.indices == sorted(set(r.indices)) and vector == dense[r.id].vector


def test_unknown_values_of_a_large_vocabulary(spark):
    from cairn.operators import features as X

    df = spark.range(0, 60_000, 1, 8).select(F.concat(F.lit("t"), "id").alias("c"), F.array(F.lit("a"), F.lit("z"), F.lit("z")).alias("l"))
    vocab = D.build_vocab(df.filter("c like '%7'"), ["c"], []).unionByName(D.build_vocab(df.select(F.array(F.lit("a")).alias("l")), [], ["l"]))
    assert {r.field: r.unknown for r in X.unknown_counts(df, vocab, ["l"], ["c"]).collect()} == {"c": 54_000, "l": 60_000}
    assert {r.field: r.unknown for r in X.unknown_counts(df.limit(0), vocab, ["l"], ["c"]).collect()} == {"c": 0, "l": 0}


def test_ranges_follow_the_number_of_values(spark):
    """Of uneven fields the small ones have one range, and the large one as many as its values ask for."""
    sizes = {"a": 1, "b": 90, "c": 1000, "d": 20_000}
    rows = spark.createDataFrame(list(sizes.items()), "field string, n long").select("field", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("x"))
    counts = rows.select("field", F.col("x").cast("double").alias("x"), F.lit(1).alias("n"))
    bounds = {r.field: r._bounds for r in ranks.ranges(counts, ["field"], "x", a_range=100, parts=64).collect()}
    assert {f: len(b) for f, b in bounds.items()} == {"a": 0, "b": 0, "c": 10, "d": 63}
    assert all(b == sorted(b) for b in bounds.values())
    got = ranks.running(counts, ["field"], "x", ["n"], a_range=100, parts=64).collect()
    assert len(got) == sum(sizes.values()) and all((r.n_upto, r.n_all, r.x_next) == (r.x, sizes[r.field], r.x + 1 if r.x < sizes[r.field] else None) for r in got)
