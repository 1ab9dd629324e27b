"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most k edits has, of any k + 1 pieces, one that occurs unchanged. An
Aho-Corasick automaton finds all pieces in one pass over a text; around each hit Myers' bit-parallel algorithm
computes the distance of the whole item.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import ids_and_text, kept, row_keys, stored, tidy

#: Characters of test items that one pass over the documents looks for; more items take more passes.
PASS_CHARS = 2_000_000


def plain(text: str) -> str:
    """Lower case, each run of white space one space, none at the ends."""
    return " ".join(text.lower().split())


def budget(item: str, rate: float) -> int:
    return int(rate * len(item))


def pieces(item: str, k: int) -> Iterator[tuple[int, str]]:
    """k + 1 adjoining pieces of about one length, with their offsets."""
    at = [i * len(item) // (k + 1) for i in range(k + 2)]
    return ((a, item[a:b]) for a, b in zip(at, at[1:], strict=False))


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of pattern to any substring of text, end of the first such substring)."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        at[c] |= 1 << i
    plus, minus, score = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(across | plus)), plus & across
        score += 1 if up & high else -1 if down & high else 0
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best[0]:
            best = (score, j + 1)
    return best


class Matcher:
    """Finds items, (id, plain text, edits allowed), in plain texts."""

    def __init__(self, items: list[tuple[int, str, int]]):
        self.items = items
        by_piece: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, item, k) in enumerate(items):
            for offset, piece in pieces(item, k):
                by_piece[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in by_piece.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the plain text) of each item that occurs within its edits."""
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (length, places) in self.automaton.iter(text):
            for n, offset in places:
                _, item, k = self.items[n]
                begin = end + 1 - length - offset
                windows[n].append((max(0, begin - k), begin + len(item) + k))
        found = []
        for n, spans in windows.items():
            item_id, item, k = self.items[n]
            spans.sort()
            joined = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            distance, end = min((d, a + e) for a, b in joined for d, e in [myers(item, text[a:b])])
            if distance <= k:
                found.append((item_id, distance, end))
        return sorted(found, key=lambda x: (x[0] is None, *x[1:], x[0] or 0))


HITS = "doc_id long, item_id long, distance int, end long"


def hits(
    docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_col: str = "text", pass_chars: int = PASS_CHARS, least_chars: int = 1,
) -> DataFrame:
    """(doc_id, item_id, distance, end): test items that occur in a text, both in plain form, within rate x their length edits.

    end is where the best match ends in the plain text. Empty and null items match nothing, and so do items
    of fewer than least_chars characters in plain form; other short ones match wherever they occur. Items that repeat, and null item_ids, each give rows of their own (null stays null). The items
    are dealt by hash into passes of about half of pass_chars characters each, so what is broadcast is bounded.
    """
    spark = docs.sparkSession
    items = stored(
        benchmark.select(F.col(f"`{item_id_col}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{item_col}`"), F.lit("")).alias("item")), "items"
    )
    size = items.agg(F.sum(F.length("item"))).first()[0] or 0
    passes = max(1, -(-2 * size // pass_chars)) if size > pass_chars else 1
    dealt = items.withColumn("_pass", F.pmod(F.xxhash64("item", "item_id"), F.lit(passes)))
    rows = ids_and_text(docs, id_col, text_col)

    def one(number: int) -> DataFrame:
        block = [(r.item_id, p, budget(p, rate)) for r in dealt.filter(F.col("_pass") == number).toLocalIterator() if len(p := plain(r.item)) >= max(1, least_chars)]
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if not shared.value:
                return
            matcher = kept(name, lambda: Matcher(shared.value))  # as long as tasks of this pass follow each other
            for batch in batches:
                found = [(d, *hit) for d, text in zip(batch.doc_id, batch.text, strict=True) for hit in matcher.find(plain(text))]
                out = pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "end"])
                yield out.astype({"item_id": "Int64"})
            tidy(name)

        return rows.mapInPandas(search, HITS)

    return reduce(DataFrame.unionByName, [one(n) for n in range(passes)])


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, item_ids (sorted; null identifiers of items aren't named). Each row is
    judged by its own text, whatever its identifier; null and empty texts hold nothing. Other columns of docs are ignored.
    Empty tables give no rows or nothing contaminated."""
    rows = row_keys(docs, id_col, text_col)
    found = stored(hits(rows.select("key", "text"), benchmark, rate, "key", "text", **columns), "hits")
    lists = found.groupBy(F.col("doc_id").alias("key")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.lit(True).alias("hit"))
    ids = rows.select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), "key")
    return ids.join(stored(lists, "contaminated"), "key", "left").select(
        "doc_id",
        F.coalesce("hit", F.lit(False)).alias("contaminated"),
        F.coalesce(F.size("item_ids"), F.lit(0)).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The rows of docs without a test item, with all their columns, whatever their names. Rows are judged as by contamination."""
    rows = row_keys(docs, id_col, text_col)
    found = stored(hits(rows.select("key", "text"), benchmark, rate, "key", "text", **columns).select(F.col("doc_id").alias("key")).distinct(), "hits")
    return rows.select("row", "key").join(found, "key", "left_anti").select("row.*")
