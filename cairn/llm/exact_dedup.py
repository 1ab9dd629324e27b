"""Exact deduplication by content-defined chunk recipes, in SQL functions only.

A text is cut once, where a word's hash says so, so equal passages give equal chunks wherever they stand. The chunks are
stored with their identifiers, SHA-256; one shuffle of the distinct chunks proves that no identifier stands for two of
them. Then documents are compared by their ordered lists of these identifiers alone: whole texts never move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import SPACE, let, scratch, stored

#: A word ends a chunk with this inverse probability; a chunk has at most MOST words.
WORDS, MOST = 128, 4096


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def chunks(text: Column, words: int = WORDS) -> Column:
    """A text's chunks, which joined give the text; none for an empty text. Lambda variables hold the words and the cuts, so
    that neither is computed again for each chunk."""
    split = F.regexp_extract_all(text, F.lit("[^ ]{0,64} |[^ ]{1,64}"), F.lit(0))

    def cut(word: Column) -> Column:
        ends = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(word), F.lit(1))),
            lambda i: (i == F.size(word)) | (i % MOST == 0) | (F.pmod(F.xxhash64(F.get(word, i - 1)), F.lit(words)) == 0),
        )

        def pieces(end: Column) -> Column:
            begin = lambda i: F.coalesce(F.get(end, i - 1), F.lit(0))
            return F.transform(end, lambda e, i: F.array_join(F.slice(word, begin(i) + 1, e - begin(i)), ""))

        return F.when(F.size(word) > 0, let(ends, pieces)).otherwise(F.array().cast("array<string>"))

    return let(split, cut)


#: How a chunk is named: by the first of these under which no two chunks share an identifier. The last is the chunk itself.
NAMES: tuple[Callable[[Column], Column], ...] = (
    lambda c: F.unhex(F.sha2(c, 256)),
    lambda c: F.concat(F.unhex(F.sha2(c, 512)), F.unhex(F.sha2(F.reverse(c), 256))),
    lambda c: F.encode(c, "UTF-8"),
)


def clashing(pieces: DataFrame) -> DataFrame:
    """pieces: arrays of (id, chunk). Identifiers that stand for more than one chunk: an empty table unless SHA-256 is broken."""
    store = pieces.select(F.inline("pieces")).groupBy("id", "chunk").agg(F.count("*").alias("n"))
    return store.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, names: tuple = NAMES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space is one space; null is the empty text. Of equal
    texts the smallest doc_id stays; null identifiers rank last, and a group of nothing but nulls has keep_id null and
    keeps all its rows. Rows that repeat the keep_id of their group all count as kept. Other columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), normalised(F.col(f"`{text_col}`")).alias("text"))
    for name in names:
        with scratch(spark):
            cut = stored(
                texts.select(
                    "doc_id", F.sha2("text", 256).alias("text_sha256"),
                    F.transform(chunks(F.col("text"), words), lambda c: F.struct(name(c).alias("id"), c.alias("chunk"))).alias("pieces"),  # noqa: B023
                ), "pieces",
            )
            if not clashing(cut).isEmpty():
                continue
            recipes = stored(cut.select("doc_id", "text_sha256", F.col("pieces.id").alias("recipe")), "recipes", outer=True)
            break
    groups = stored(recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return recipes.join(groups, "recipe").select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    )
