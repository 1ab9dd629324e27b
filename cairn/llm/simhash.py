"""SimHash near-duplicates through a Gray-ordered hierarchical index.

Two fingerprints of 64 bits that differ in at most `bits` = 4 places agree in two whole parts of six, so every pair
that counts meets under one of 15 keys. Under a key the fingerprints are sorted by Gray rank, where neighbours share
most bits; runs of eight form a node that keeps the bits which all of them share, runs of eight nodes form an upper
node, and so on. A search adds up the differing bits from the root down and leaves a whole group as soon as the sum
is over the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import near_copies
from cairn.llm.common import NULL_ID, ids_and_text, real_id, scratch, stored, tidy
from cairn.llm.components import components

#: Widths of the six parts of a fingerprint, from the lowest bit.
PARTS = (11, 11, 11, 11, 10, 10)
#: Fingerprints under one key that one task compares; more are dealt out in pairs of blocks.
BLOCK = 4096
FAN = 8  # children of a node, a power of two


def fingerprint(text: str, words: int = 4) -> int:
    """Lower case for A-Z, words between ASCII white space, shingles with repeats; XXH64 with seed 42; a bit is set if it
    is set in over half the hashes. Fewer words than a shingle give one shingle, no words fingerprint zero."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    n = max(1, len(w) - words + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return ids_and_text(docs, id_col, text_col).select("doc_id", fp("text").alias("fp"))


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in Gray order."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the groups of a[i] and b[i]; a group's label is its least member."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def near(group: np.ndarray, code: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of rows of one group whose codes differ in at most `bits` places. Rows are sorted by (group, Gray rank)."""
    n = len(code)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, n])
    pos = np.arange(n) - np.repeat(start, size)
    owner = np.repeat(np.arange(len(start)), size)
    levels = []  # from the rows up: first row, end row, shared bits, pattern, first child, end child
    first, end, mask = np.arange(n), np.arange(1, n + 1), np.full(n, ~np.uint64(0))
    shift, step = 0, FAN.bit_length() - 1
    levels.append((first, end, mask, code, first, end))
    while (size > 1 << shift).any():
        shift += step
        own, at = owner[first], pos[first] >> shift
        new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1])])
        last = np.r_[new[1:], len(first)]
        pattern = levels[-1][3][new]
        differ = ~mask | (levels[-1][3] ^ np.repeat(pattern, last - new))
        mask = ~np.bitwise_or.reduceat(differ, new)
        first, end = first[new], end[last - 1]
        levels.append((first, end, mask, pattern, new, last))
    root = np.searchsorted(first, np.arange(n), side="right") - 1
    for lo in range(0, n, 8192):
        query = np.arange(lo, min(n, lo + 8192))
        node, sofar, seen = root[query], np.zeros(len(query), dtype=np.int64), np.zeros(len(query), dtype=np.uint64)
        for depth in range(len(levels) - 1, -1, -1):
            _, e, m, p, child, child_end = levels[depth]
            sofar = sofar + np.bitwise_count((code[query] ^ p[node]) & m[node] & ~seen)
            keep = (sofar <= bits) & (e[node] > query + 1)
            if depth == 0:
                yield query[keep], node[keep]
                break
            query, node, sofar = query[keep], node[keep], sofar[keep]
            many = child_end[node] - child[node]
            seen = np.repeat(m[node], many)
            begin = np.repeat(child[node] - np.r_[0, np.cumsum(many)[:-1]], many) if len(many) else np.array([], dtype=np.int64)
            query, sofar = np.repeat(query, many), np.repeat(sofar, many)
            node = begin + np.arange(len(query))


def spanning_links(group: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what `near` connects: one for each fingerprint that isn't the first of its class."""
    code = fps.view(np.uint64)
    order = np.lexsort((gray_rank(code), group))
    group, code = group[order], code[order]
    label = np.arange(len(code))
    for a, b in near(group, code, bits):
        merge(label, a, b)
    moved = label != np.arange(len(code))
    return code[moved].view(np.int64), code[label[moved]].view(np.int64)


def _keys(fp: Column) -> Column:
    at = np.r_[0, np.cumsum(PARTS)]
    part = [F.shiftrightunsigned(fp, int(at[i])).bitwiseAND(F.lit((1 << w) - 1)) for i, w in enumerate(PARTS)]
    return F.array(
        *(
            F.lit(k << 22) + part[i] * (1 << PARTS[j]) + part[j]
            for k, (i, j) in enumerate(combinations(range(len(PARTS)), 2))
        )
    )


def near_links(fps: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """fps: distinct fingerprints (fp). Links (a, b) whose components are those of all pairs that differ in at most
    `bits` (up to 4) places."""
    if not 0 <= bits <= len(PARTS) - 2:
        raise ValueError(f"bits must be 0 to {len(PARTS) - 2}")
    keyed = fps.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp")
    hot = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block), "hot")
    hot = hot.select("key", F.ceil(F.col("n") / (block // 2)).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pair = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other) + 1,
    )
    dealt = keyed.join(hot, "key", "left").select(
        "key", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair)).alias("pair"), "fp"
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if batch.empty:
                continue
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            tail = int(((rest.key == rest.key.iat[-1]) & (rest.pair == rest.pair.iat[-1])).to_numpy().argmax())
            if tail:
                yield found(rest.iloc[:tail])
                rest = rest.iloc[tail:].reset_index(drop=True)
        if rest is not None:
            yield found(rest)

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        group = (rows.key.diff().ne(0) | rows.pair.diff().ne(0)).cumsum().to_numpy()
        a, b = spanning_links(group, rows.fp.to_numpy(), bits)
        return pd.DataFrame({"a": a, "b": b})

    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInPandas(search, "a long, b long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over
    fingerprints that differ in at most `bits` places).

    Null and empty texts have fingerprint zero and link like any other. A null doc_id takes part; its own doc_id is
    given as null and it never names a component unless the whole component has null identifiers (then null). Repeated
    rows give repeated rows. Other columns are ignored; an empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    reps = stored(prints.groupBy("fp").agg(F.min(real_id()).alias("rep")), "reps")
    roots = components(near_links(reps.select("fp"), bits))
    rooted = stored(
        reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")),
        "rooted",
    )
    heads = stored(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "heads")
    named = stored(rooted.join(heads, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(
        real_id().alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: Rows of two longs that are broadcast at most.
FEW = 200_000


def verified_links(rows: DataFrame, sets: DataFrame, words: int, least: float, bits: int, repeated: bool) -> DataFrame:
    """Links (a, b) of sets whose fingerprints differ in at most `bits` places and whose similarity is at least `least`, by the
    Gray-ordered index: sets of one fingerprint are linked to the first of them, and these along the index's links."""
    reps = stored(sets.groupBy("fp").agg(F.min("sid").alias("rep")), "reps")
    same = sets.join(reps, "fp").filter("sid != rep").select(F.col("rep").alias("a"), F.col("sid").alias("b"))
    found = stored(near_links(reps.select("fp"), bits).distinct(), "found")
    ends = reps.select(F.col("fp").alias("a"), F.col("rep").alias("x")), reps.select(F.col("fp").alias("b"), F.col("rep").alias("y"))
    near = found.join(ends[0], "a").join(ends[1], "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = stored(same.unionByName(near).distinct(), "pairs")
    return near_copies.similar(pairs, rows, sets.select("sid", "doc_id", "tag"), words, least, repeated)


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, bits: int = 4, id_bits: int = 64,
) -> DataFrame:
    """One row of docs for each component of near copies, with all its columns: the one with the smallest doc_id. Near copies are
    texts whose sets of shingles have a Jaccard similarity of at least `least`.

    The Gray-ordered index finds those whose fingerprints differ in at most `bits` places, which are nearly all; each link is
    verified on the sets. Fingerprints of texts at the limit differ in about ten places, which no index of this kind can hold, so
    an exact join of the sets that aren't linked yet completes the links. Texts without words are copies of each other. Rows
    are judged by themselves, so a null or repeated identifier takes part like any other; a null one comes last. Column names
    may be any. An empty table gives an empty result.

    Sets are told apart by 128 bits; `id_bits` of them name a set, and names that sets share are changed. Rows are told apart by their
    identifier and 128 bits of their text.
    """
    spark = docs.sparkSession
    tag = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("tag")
    whole = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc_id"), tag(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )
    rows = ids_and_text(docs, id_col, text_col).withColumn("tag", tag(F.col("text")))
    with scratch(spark):
        counts = spark.sparkContext.broadcast(near_copies.shingle_counts(rows, words))  # CELLS numbers

        mask = np.int64(-1 if id_bits >= 64 else (1 << id_bits) - 1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in (whole.iloc[at : at + 500] for whole in batches for at in range(0, len(whole), 500)):
                sid, more, fp, size, prefix = [], [], [], [], []
                for text in batch.text:
                    codes = near_copies.shingles(text, words)
                    fp.append(majority(codes) if len(codes) else 0)
                    for out, x in zip((sid, more, size, prefix), near_copies.set_and_prefix(codes, counts.value, least), strict=True):
                        out.append(x)
                long = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
                yield pd.DataFrame({"doc_id": batch.doc_id.to_numpy(), "tag": batch.tag, "sid": long(sid) & mask, "more": long(more), "fp": long(fp), "size": size, "prefix": prefix})
            tidy()

        own = F.struct((F.col("doc_id") == NULL_ID).alias("none"), "doc_id", "tag")  # a null identifier last
        with scratch(spark):
            full = stored(rows.mapInPandas(run, "doc_id long, tag binary, sid long, more long, fp long, size int, prefix array<long>"), "prints")
            full = near_copies.told_apart(full)
            head = stored(full.groupBy("sid").agg(F.min(own).alias("first")).select("sid", "first.doc_id", "first.tag"), "heads")
            sets = full.join(head, ["sid", "doc_id", "tag"], "left_semi")
            repeated = not full.groupBy("doc_id", "tag").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
            sets = stored(sets.dropDuplicates(["sid"]) if repeated else sets, "sets", outer=True)
            prints = stored(full.select("doc_id", "tag", "sid"), "prints", outer=True)
        known = stored(verified_links(rows, sets, words, least, bits, repeated), "known")
        roots = components(near_copies.near_links(rows, sets, known, words, least, repeated)).withColumnRenamed("node", "sid")
        rooted = sets.select("sid", "doc_id", "tag").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        kept = stored(rooted.groupBy("root").agg(F.min(own).alias("first")).select("first.doc_id", "first.tag"), "kept")
        all_ = prints.groupBy("doc_id", "tag").agg(F.count("*").alias("n"))
        gone = stored(all_.join(kept, ["doc_id", "tag"], "left_anti").select("doc_id", "tag"), "gone", outer=True)
        twice = stored(all_.filter("n > 1").join(kept, ["doc_id", "tag"], "left_semi").select("doc_id", "tag"), "twice", outer=True)
    key = ["doc_id", "tag"]
    out = whole.join(F.broadcast(gone) if gone.count() <= FEW else gone, key, "left_anti")
    if not twice.isEmpty():  # equal rows that repeat an identifier: one of each stays
        out = out.join(twice, key, "left_anti").unionByName(out.join(twice, key, "left_semi").dropDuplicates(key))
    return out.select("row.*")
