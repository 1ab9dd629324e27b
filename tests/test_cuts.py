"""Cuts of long chains by doubling jumps, against a plain fold."""

import random

from pyspark.sql import functions as F

from cairn.operators import segments as V


def plain(frames, gap):
    kept = []
    for f in sorted(frames):
        if not kept or f - kept[-1] >= gap:
            kept.append(f)
    return kept


def test_long_chains_are_cut_as_by_a_fold(spark):
    rng = random.Random(11)
    gaps = {"a": 3, "b": 10, "c": 7, "d": 1, "e": 4}
    rows = [("a", f) for f in range(0, 200)] + [("b", f) for f in rng.sample(range(3000), 900)] + [("c", f) for f in rng.sample(range(400), 60)]
    rows += [("d", f) for f in range(50, 60)] + [("e", 5)]
    df = spark.createDataFrame([(k, f, 0.9, gaps[k]) for k, f in rows] + [(k, f, 0.1, gaps[k]) for k in gaps for f in range(7)], "k string, f long, d double, g int")
    want = {k: plain([f for j, f in rows if j == k], g) for k, g in gaps.items()}
    for long, span in ((V.LONG, V.SPAN), (5, 16), (1, 4), (0, 100)):
        got = {r.k: r.cuts for r in V.detect_cuts(df, "k", "f", "d", F.col("g"), long=long, span=span).collect()}
        assert got == want


def test_one_key_that_never_pauses(spark):
    df = spark.range(0, 60_000, 1, 8).select(F.lit("v").alias("k"), F.col("id").alias("f"), F.lit(1.0).alias("d"))
    got = V.detect_cuts(df, "k", "f", "d", 4, span=5000).first().cuts
    assert got == list(range(0, 60_000, 4))
    assert V.detect_cuts(df.limit(0), "k", "f", "d", 4).count() == 0
