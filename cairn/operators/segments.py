"""Frames to segments. Input is a table of frames; windows are inside one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.scalars import label_rhythm, to_double
from cairn.functions.stats import bins_below
from cairn.operators.lineage import checkpointed
from cairn.operators.ranks import long_numbers, quantiles


def hist_distance(df: DataFrame, key: str, order: str, hist: str) -> DataFrame:
    """V1. Adds distance: Bhattacharyya distance to the previous frame's histogram of the same key, null for the first."""
    prev = F.lag(hist).over(W.partitionBy(key).orderBy(order))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    dot = F.aggregate(F.zip_with(F.col(hist), F.col("_prev"), lambda a, b: F.sqrt(a.cast("double") * b.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(total(F.col(hist)) * total(F.col("_prev")))
    distance = F.sqrt(F.greatest(F.lit(0.0), 1 - F.try_divide(dot, norm)))
    return df.withColumn("_prev", prev).withColumn("distance", F.when(F.col("_prev").isNotNull(), distance)).drop("_prev")


#: A chain of more candidates isn't gathered in one row, and the frames that one task seeks successors in.
LONG, SPAN = 10_000, 1 << 16


def detect_cuts(df: DataFrame, key: str, frame: str, distance: str, gap: Column | int, threshold: float = 0.55, long: int = LONG, span: int = SPAN) -> DataFrame:
    """V2. (key, cuts): frames over the threshold, each at least `gap` frames after the last accepted one. A candidate at least a gap
    after the candidate before it is always accepted, so each such one begins a chain of its own. A chain of up to `long` candidates is
    folded in a row; in longer ones every candidate finds its successor, and what the chain's start reaches is marked by doubling jumps."""
    rows = df.filter(F.col(distance) > threshold).select(key, F.col(frame).cast("long").alias("f"), (F.lit(gap) if isinstance(gap, int) else gap).cast("long").alias("g"))
    rows = rows.join(rows.groupBy(key).agg(F.max("g").alias("_g")), key) if not isinstance(gap, int) else rows.withColumn("_g", F.col("g"))
    by = W.partitionBy(key).orderBy("f")
    begins = F.coalesce(F.col("f") - F.lag("f").over(by) >= F.col("_g"), F.lit(True))
    chains = rows.withColumn("_new", begins.cast("long")).withColumn("_chain", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    large = checkpointed(chains.groupBy(key, "_chain").agg(F.count("*").alias("n")).filter(F.col("n") > long).select(key, "_chain"))
    if large.isEmpty():
        return _cut_lists(_folded(chains, key), key)
    marked = _reached(chains.join(large, [key, "_chain"], "left_semi").select(key, "f", "_g", "_new"), key, span)
    return _cut_lists(_folded(chains.join(large, [key, "_chain"], "left_anti"), key).unionByName(marked.select(key, F.array("f").alias("kept"))), key)


def _cut_lists(kept: DataFrame, key: str) -> DataFrame:
    return kept.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("kept"))).alias("cuts"))


def _folded(chains: DataFrame, key: str) -> DataFrame:
    lists = chains.groupBy(key, "_chain").agg(F.sort_array(F.collect_list("f")).alias("fs"), F.max("_g").alias("_g"))
    start = F.struct(F.get("fs", 0).alias("last"), F.array(F.get("fs", 0)).alias("kept"))
    far = lambda acc, f: f - acc["last"] >= F.col("_g")
    fold = F.aggregate(
        "fs", start,
        lambda acc, f: F.struct(F.when(far(acc, f), f).otherwise(acc["last"]).alias("last"), F.when(far(acc, f), F.concat(acc["kept"], F.array(f))).otherwise(acc["kept"]).alias("kept")),
        lambda acc: acc["kept"],
    )
    return lists.select(key, fold.alias("kept"))


def successors(rows: DataFrame, key: str, span: int = SPAN) -> DataFrame:
    """rows: (key, f, _g) with less than _g between neighbours of a chain. (key, f, to): the first candidate at least _g after f, if that is less
    than 2 _g after it. Candidates and the places that seek one are merged in spans of frames; a span also has the next one's beginning."""
    of = lambda pos: F.floor(pos / span)
    f, g = F.col("f"), F.col("_g")
    seekers = rows.select(key, of(f + g).alias("_span"), (f + g).alias("_pos"), f.alias("seeker"), F.lit(None).cast("long").alias("found"), "_g")
    spans = F.sequence(of(f - g), of(f))  # a seeker up to _g before a candidate may be in a span before
    found = rows.select(key, F.explode(spans).alias("_span"), f.alias("_pos"), F.lit(None).cast("long").alias("seeker"), f.alias("found"), "_g")
    down = W.partitionBy(key, "_span").orderBy(F.desc("_pos"), F.col("seeker").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    t = seekers.unionByName(found).withColumn("to", F.last("found", ignorenulls=True).over(down))
    return t.filter(F.col("seeker").isNotNull() & (F.col("to") < F.col("_pos") + F.col("_g"))).select(key, F.col("seeker").alias("f"), "to")


def _reached(rows: DataFrame, key: str, span: int) -> DataFrame:
    """(key, f) of what the chains' starts (_new = 1) reach from successor to successor: as many rounds as the binary logarithm of the
    longest run of accepted frames."""
    reached, jumps = rows.filter("_new = 1").select(key, "f"), checkpointed(successors(rows, key, span))
    while not jumps.isEmpty():
        reached = checkpointed(reached.unionByName(reached.join(jumps, [key, "f"]).select(key, F.col("to").alias("f"))).distinct())
        far = jumps.select(key, F.col("f").alias("to"), F.col("to").alias("_far"))
        jumps = checkpointed(jumps.join(far, [key, "to"]).select(key, "f", F.col("_far").alias("to")))
    return reached


def cuts_to_shots(videos: DataFrame, cuts: DataFrame, key: str, frames: str, fps: str) -> DataFrame:
    """V3. One row a shot: key, shot_no, start, end, start_sec, end_sec (3 digits), mid. videos: (key, frames, fps), one row a key."""
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.coalesce("cuts", F.array().cast("array<bigint>")))
    t = videos.join(cuts, key, "left").filter(F.col(frames) > 0).select(key, frames, fps, F.posexplode(starts).alias("shot_no", "start"))
    after = F.lead("start").over(W.partitionBy(key).orderBy("shot_no"))
    t = t.withColumn("end", F.coalesce(after, F.col(frames).cast("bigint")) - 1)
    sec = lambda c: F.bround(F.col(c) / F.col(fps), 3)
    return t.select(key, "shot_no", "start", "end", sec("start").alias("start_sec"), sec("end").alias("end_sec"), F.floor((F.col("start") + F.col("end")) / 2).alias("mid"))


def video_stats(shots: DataFrame, videos: DataFrame, key: str, frames: str, fps: str, movement: str | None = None, kinds: Sequence[str] = ()) -> DataFrame:
    """V4. Per key: num_shots, avg_shot_len_sec, cuts_per_30s, editing_rhythm and a count of each movement."""
    length = (F.col("end") - F.col("start") + 1) / F.col(fps)
    counts = [F.count_if(F.col(movement) == k).alias(k) for k in kinds] if movement else []
    t = shots.join(videos.select(key, frames, fps), key).groupBy(key).agg(
        F.count("*").alias("num_shots"), F.avg(length).alias("avg_shot_len_sec"), F.first(F.col(frames) / F.col(fps)).alias("_dur"), *counts
    )
    cuts = F.coalesce(F.try_divide(F.greatest(F.col("num_shots") - 1, F.lit(0)), F.col("_dur")) * 30, F.lit(0.0))
    t = t.withColumn("cuts_per_30s", cuts)
    return t.select(key, "num_shots", "avg_shot_len_sec", "cuts_per_30s", label_rhythm("cuts_per_30s").alias("editing_rhythm"), *kinds)


def segment_durations(df: DataFrame, key: str, segments: str, fps: str, frames: str) -> DataFrame:
    """V5. One row a real segment: key, seg_no, n_frames, seconds, ratio (at most 1); [-1,-1] and [0,0] are padding."""
    t = df.select(key, fps, frames, F.posexplode(segments).alias("seg_no", "s"))
    t = t.filter(~((F.get("s", 0) == F.get("s", 1)) & F.get("s", 0).isin(-1, 0)))
    n = F.get("s", 1) - F.get("s", 0) + 1
    return t.select(
        key, "seg_no", n.alias("n_frames"), (n / F.col(fps)).alias("seconds"), F.least(F.try_divide(n, F.col(frames)), F.lit(1.0)).alias("ratio")
    )


def quantile_code(df: DataFrame, col: str, step: float, out: str = "code", accuracy: int | None = None) -> DataFrame:
    """V6. Adds the equal-frequency code of a number: how many of the 1 / step + 1 quantile edges are below it."""
    n = round(1 / step)
    edges = quantiles(long_numbers(df, [col]), ["field"], [i / n for i in range(n + 1)], accuracy).agg(F.any_value("q").alias("_e"))  # one row, null of no values
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(to_double(col).isNotNull(), bins_below(F.col("_e"), to_double(col)))).drop("_e")  # one row
