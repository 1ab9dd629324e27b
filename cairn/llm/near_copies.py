"""Verification and completion of near copies: an exact set-similarity join on word shingles.

A text is the set of its shingles. Two texts are near copies if the Jaccard similarity of their sets is at least `least`.
Shingles are ordered by rarity, so that near copies share one of their short prefixes; the length and place filters
rule out most other pairs and the rest are verified on the whole sets. No similar pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bit_table, cell_counts, has_bit, stored, tidy
from cairn.llm.components import components

#: Cells of the table of shingle counts: shingles share a cell by hash, which only affects their order.
CELLS = 1 << 20
#: Bits of the table of shingles that several prefixes have.
BITS = 1 << 25
#: Rows of two longs that are broadcast at most.
FEW = 200_000
SLACK = 1e-9


def shingles(text: str, words: int) -> np.ndarray:
    """A text's shingles, repeats included, as 64-bit hashes; words as in simhash.fingerprint. Fewer words than a shingle give
    one shingle, no words none."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, w), dtype="<u8", count=len(w))
    n = max(1, len(w) - words + 1)
    out = np.full(n, min(words, len(w)), dtype=np.uint64)
    for i in range(min(words, len(w))):
        out = (out ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def shingle_counts(rows: DataFrame, words: int) -> np.ndarray:
    """How many texts hold the shingles of each cell; CELLS numbers whatever the size of the input."""

    def cells_of(texts: pd.Series) -> Iterator[np.ndarray]:
        for text in texts:
            yield (np.unique(shingles(text, words)) & np.uint64(CELLS - 1)).astype(np.int64)

    return cell_counts(rows.select("text"), CELLS, cells_of)


def set_and_prefix(codes: np.ndarray, table: np.ndarray, least: float) -> tuple[int, int, int, np.ndarray]:
    """(both halves of a 128-bit hash of the set of shingles, its size, the rarest of them: its prefix). table: counts of the cells."""
    own = np.unique(codes)
    whole = xxhash.xxh3_128_intdigest(own.tobytes(), 42)
    rare = own[np.argsort(table[(own & np.uint64(CELLS - 1)).astype(np.int64)], kind="stable")]
    return whole & (1 << 64) - 1, whole >> 64, len(own), rare[: len(own) - int(np.ceil(least * len(own) - SLACK)) + 1].view(np.int64)


def told_apart(prints: DataFrame) -> DataFrame:
    """prints: rows with sid and more, the halves of a set's hash. Stored, with a sid that no two sets share: where sets of one sid differ in
    more, both get new ones."""
    tries = 0
    while True:
        clash = stored(prints.groupBy("sid").agg(F.min("more").alias("lo"), F.max("more").alias("hi")).filter("lo != hi").select("sid"), "clashes")
        if clash.isEmpty():
            return prints.drop("more")
        tries += 1
        new = prints.join(clash.withColumn("_clash", F.lit(True)), "sid", "left")
        sid = F.when(F.col("_clash"), F.xxhash64("sid", "more", F.lit(tries))).otherwise(F.col("sid"))
        prints = stored(new.withColumn("sid", sid).select(*prints.columns), "prints")


def compatible(least: float) -> Column:
    """Whether sets a and b can be similar, by length and by place in the prefix: similar sets are found under the first
    shingle that they share, and all that they share stands from there on."""
    need = F.ceil((F.col("a.size") + F.col("b.size")) * (least / (1 + least)) - SLACK)
    return F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place")) >= need


def similar(pairs: DataFrame, rows: DataFrame, firsts: DataFrame, words: int, least: float, repeated: bool) -> DataFrame:
    """Those of the pairs (a, b) of sids whose sets are similar. Sets are made again from one text each; repeated: whether equal
    rows that share an identifier may give a set more than once."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = stored(firsts.join(wanted, "sid", "left_semi"), "wanted")
    texts = rows.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, ["doc_id", "tag"]).select("sid", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.iloc[at : at + 500]
                yield pd.DataFrame({"sid": batch.sid.to_numpy(), "codes": [np.unique(shingles(t, words)).tobytes() for t in batch.text]})
        tidy()

    @F.pandas_udf("boolean")
    def check(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: bytes, q: bytes) -> bool:
            a, b = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            return common >= least * (len(a) + len(b) - common) - SLACK

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype=bool)

    sets = texts.mapInPandas(run, "sid long, codes binary")
    sets = stored(sets.dropDuplicates(["sid"]) if repeated else sets, "shingles")
    sides = pairs.join(sets.select(F.col("sid").alias("a"), F.col("codes").alias("x")), "a").join(
        sets.select(F.col("sid").alias("b"), F.col("codes").alias("y")), "b"
    )
    return sides.filter(check("x", "y")).select("a", "b")


def with_bits(sets: DataFrame, shared: DataFrame) -> DataFrame:
    """(sid, size, place, shingle) of the shingles of prefixes that have a bit of a shared one: nearly only these, as long as they
    are fewer than the bits. So the others aren't moved a second time."""
    table = bit_table(shared.select(F.col("shingle").bitwiseAND(BITS - 1)), BITS)
    bits = sets.sparkSession.sparkContext.broadcast(table)  # BITS bits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[at : at + 1000] for whole in batches for at in range(0, len(whole), 1000)):
            many = np.array([len(x) for x in batch.prefix], dtype=np.int64)
            if not many.sum():
                continue
            flat = np.concatenate(list(batch.prefix)).astype(np.int64)
            bit, row = flat & (BITS - 1), np.repeat(np.arange(len(many)), many)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)
            at = np.flatnonzero(has_bit(bits.value, bit))
            yield pd.DataFrame({"sid": batch.sid.to_numpy()[row[at]], "size": batch["size"].to_numpy()[row[at]], "place": place[at].astype(np.int32), "shingle": flat[at]})

    return sets.select("sid", "size", "prefix").mapInPandas(run, "sid long, size int, place int, shingle long")


def near_links(rows: DataFrame, sets: DataFrame, known: DataFrame, words: int, least: float, repeated: bool) -> DataFrame:
    """rows: (doc_id, tag, text); sets: (sid, size, prefix, doc_id, tag), one row per set; known: links (a, b) of similar sets that
    have been found before. Links, the known ones among them, whose components are those of all similar pairs.

    First each set is held against the least one under each shingle of its prefix, where the known links don't connect them
    yet; what that connects needn't be compared any more, and of the rest all pairs under a shingle are."""

    def rooted(links: DataFrame, of: DataFrame) -> DataFrame:
        roots = components(links).withColumnRenamed("node", "sid")
        return of.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))

    shingle = sets.select(F.explode("prefix").alias("shingle"))
    shared = stored(shingle.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").select("shingle"), "shared")
    placed = rooted(known, with_bits(sets, shared).join(shared, "shingle", "left_semi"))
    placed = stored(placed, "placed")
    head = F.min(F.struct("sid", "size", "place", "root")).alias("head")
    heads = placed.groupBy("shingle").agg(head, F.max("root").alias("hi"), F.min("root").alias("lo")).filter("lo != hi").select("shingle", "head.*")
    firsts = sets.select("sid", "doc_id", "tag")

    met = heads.alias("a").join(placed.alias("b"), "shingle").filter((F.col("a.root") != F.col("b.root")) & compatible(least))
    pairs = stored(met.select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b")).distinct(), "pairs")
    links = stored(known.unionByName(similar(pairs, rows, firsts, words, least, repeated)), "links")

    again = stored(rooted(links, placed.drop("root")), "rooted")
    apart = again.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("shingle")
    rest = stored(again.join(apart, "shingle"), "rest")
    met = rest.alias("a").join(rest.alias("b"), "shingle").filter(
        (F.col("a.sid") < F.col("b.sid")) & (F.col("a.root") != F.col("b.root")) & compatible(least)
    )
    more = met.select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    return links.unionByName(stored(similar(stored(more, "pairs"), rows, firsts, words, least, repeated), "links"))
