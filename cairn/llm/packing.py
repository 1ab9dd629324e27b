"""Packing of token sequences by minimum bin slack.

Bins depend on lengths alone, and there are at most `capacity` lengths: the fullest combination is sought over the
histogram of lengths by a subset-sum over a bitset, then removed as often as the histogram allows. So the driver's work is
bounded by the capacity, whatever the number of documents; the pieces themselves are placed by their rank among the
pieces of their length, in Spark.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import ids_and_text, real_id, stored, tidy
from cairn.llm.tokens import WordEncoder, tokenizer_source

#: Words that a worker remembers (see tokens.REMEMBERED); fewer than where ids are all that a job does.
REMEMBERED = 200_000
#: A row of the plan: pieces of this length, so many of them in each of `bins` bins from bin `first`, from this offset.
PLAN = np.dtype([("length", "<i8"), ("uses", "<i8"), ("bins", "<i8"), ("first", "<i8"), ("offset", "<i8")])


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Length -> number of pieces of the fullest bin that holds a longest piece. counts: available pieces by length."""
    longest = max(counts)
    room, steps, reach = capacity - longest, [], 1
    keep = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length] - (length == longest), room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & keep
            left, k = left - take, 2 * k
        if reach >> room & 1:
            break
    used, total = {longest: 1}, reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan_bins(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """The bins for a histogram of lengths (1 to capacity), as rows of PLAN sorted by length."""
    counts, rows, first = {k: n for k, n in histogram.items() if n}, [], 0
    while counts:
        used = fullest(counts, capacity)
        bins, offset = min(counts[k] // n for k, n in used.items()), 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, n, bins, first, offset))
            offset += length * n
            counts[length] -= n * bins
            if not counts[length]:
                del counts[length]
        first += bins
    plan = np.array(rows, dtype=PLAN)
    return plan[np.argsort(plan["length"], kind="stable")]


def pack(pieces: DataFrame, capacity: int, length_col: str = "length", tie: tuple[str, ...] = ()) -> DataFrame:
    """Adds sequence_id (long, from 0) and offset (long) to each row of pieces. Lengths must be 1 to capacity; `tie` are
    columns that order pieces of one length. An empty table stays empty; repeated rows get places of their own. Columns of pieces
    may have any names but these two, which are replaced."""
    spark, names = pieces.sparkSession, [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    by = [F.col(f"`{c}`") for c in (tie or pieces.columns)]
    pieces = pieces.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(f"`{length_col}`").cast("int").alias("_size"), F.struct(*by).alias("_tie"))
    length_col = "_size"
    lengths = pieces.groupBy(F.col(length_col).alias("length")).agg(F.count("*").alias("n"))
    rows = lengths.filter(F.col("length").between(1, capacity)).collect()  # at most `capacity` rows
    histogram = {r.length: r.n for r in rows}
    total = sum(histogram.values())
    # pieces of one length are dealt out so that no task ranks all of a common length
    dealt = max(1, min(1 << 14, total // 500))
    own = pieces.withColumn("_dealt", F.pmod(F.xxhash64("_tie"), F.lit(dealt)))
    sizes = own.groupBy(F.col(length_col).alias("_length"), F.col("_dealt").alias("_part")).agg(F.count("*").alias("_n"))
    before = W.partitionBy("_length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = own.withColumn("_rank", F.row_number().over(W.partitionBy(length_col, "_dealt").orderBy("_tie")))
    ranked = ranked.join(sizes, (F.col(length_col) == F.col("_length")) & (F.col("_dealt") == F.col("_part")))
    plan = plan_bins(histogram, capacity)
    starts = np.r_[0, np.cumsum(plan["uses"] * plan["bins"])[:-1]] if len(plan) else np.zeros(0, dtype=np.int64)
    base = {int(k): int(v) for k, v in zip(plan["length"][::-1], starts[::-1], strict=True)}  # first place of each length
    shared = spark.sparkContext.broadcast((plan, starts, base))  # bounded by the capacity

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        plan, starts, base = shared.value
        at = length.map(base).to_numpy(dtype=np.int64) + rank.to_numpy(dtype=np.int64)
        row = np.searchsorted(starts, at, side="right") - 1
        p, inside = plan[row], at - starts[row]
        return pd.DataFrame(
            {"sequence_id": p["first"] + inside // p["uses"], "offset": p["offset"] + inside % p["uses"] * p["length"]}
        )

    placed = ranked.withColumn("_place", place(F.col(length_col).cast("long"), F.col("_before") + F.col("_rank") - 1))
    return placed.select("_row.*", "_place.sequence_id", "_place.offset")


def cut_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Ids of each text and end_id, cut into pieces of at most `capacity`: doc_id, piece, start, length, ids_crc32 and, if
    asked for, ids (little-endian unsigned 32-bit integers). Null texts count as empty; null identifiers stay null."""
    source, end = tokenizer_source(docs.sparkSession, tokenizer), struct.pack("<I", end_id)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder.of(source.value, REMEMBERED)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.doc_id, encoder.ids(batch.text), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            yield pd.DataFrame(rows, columns=columns)
        tidy(WordEncoder.name(source.value))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = ids_and_text(docs, id_col, text_col).mapInPandas(cut, schema)
    return pieces.withColumn("doc_id", real_id())


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids). Only documents longer
    than the capacity are cut. Repeated rows are packed as often as they stand; an empty table gives an empty result."""
    pieces = stored(cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return pack(pieces, capacity, tie=("doc_id", "start", "ids_crc32"))
