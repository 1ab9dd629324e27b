"""The trie of conversations' prefixes by ROLLUP over columns of turns.

A conversation is cut into blocks of BLOCK turns, one row a block with a column for each turn's id. One ROLLUP over these
columns aggregates all prefixes that end in a block, at once for all blocks: a block is keyed by the node in which the
block before ended, so that only conversations that agree up to there meet. A node is named by its depth and 128 bits
that follow from its turns and their places.

Sums over subtrees need no walk: what a node adds to all its ancestors is booked with one member that passes through
them all, its smallest, and a second ROLLUP adds up the members' accounts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import scratch, stored
from cairn.llm.turns import before, digest, ordered_sha256, placed

#: Turns in a block.
BLOCK = 8
NODE = ["depth", "p1", "p2"]
#: Identifiers of so many neighbouring values are joined into one piece of a node's list.
PIECE_BITS = 12


def turn_rows(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, pos, tid, chars): turns by their order, nulls first, equal ones by content. Rows without conv_id are left out."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), digest(role, text).alias("tid"), F.char_length(text).alias("chars")
    ).filter("conv_id is not null")
    return placed(rows, "conv_id", ["turn", "tid"]).drop("turn")


def spliced(rows: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """rows: (conv_id, pos, tid, chars). Each conversation's first `head` turns give way to the first `head` (fewer, if it has fewer, at most
    `most`) turns of conversation `base`; both are columns of conv_id. Returns the rows and (conv_id, n): some may be left with none."""
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"base": base, "head": F.least(head.cast("int"), F.lit(most))})
    firsts = rows.filter(F.col("pos") <= most).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "chars"))).alias("first"))
    none = F.array().cast("array<struct<pos:bigint,tid:binary,chars:int>>")
    convs = convs.join(firsts.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("first", F.slice(F.coalesce("first", none), F.lit(1), F.col("head")))
    convs = stored(convs.withColumn("new", F.size("first")), "spliced")
    own = rows.join(convs.select("conv_id", "head", "new"), "conv_id").filter("pos > head")
    own = own.select("conv_id", (F.col("pos") - F.col("head") + F.col("new")).alias("pos"), "tid", "chars")
    members = convs.select("conv_id", (F.col("new") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("n"))
    return convs.select("conv_id", F.inline("first")).unionByName(own), members


def _marks(pos: Column, tid: Column) -> tuple[Column, Column]:
    """A turn's share in the names of the nodes below it, two numbers to be joined by exclusive or."""
    return F.xxhash64(pos.cast("long"), tid), F.xxhash64(tid, F.lit(7), pos.cast("long"), tid)


def _blocks(rows: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """(conv_id, block, n: turns in it, x1, x2: their marks, before_x1, before_x2: the node before, t1 ... : their ids)."""
    marks = dict(zip(("x1", "x2"), _marks(F.col("pos"), F.col("tid")), strict=True))
    number = F.floor((F.col("pos") - 1) / block).cast("long").alias("block")
    cut = rows.withColumns(marks).groupBy("conv_id", number).agg(
        F.count("*").alias("n"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sort_array(F.collect_list(F.struct("pos", "tid"))).alias("t")
    )
    zero = F.lit(0).cast("long")
    empty = members.filter("n = 0").select("conv_id", *(zero.alias(c) for c in ("block", "n", "x1", "x2")), F.array().cast("array<struct<pos:bigint,tid:binary>>").alias("t"))
    keyed = before(cut.unionByName(empty), "conv_id", "block", {"x1": ("bit_xor", 0), "x2": ("bit_xor", 0)})
    return keyed.select("conv_id", "block", "n", "x1", "x2", "before_x1", "before_x2", *[F.get("t", i)["tid"].alias(f"t{i + 1}") for i in range(block)])


def _rollup(blocks: DataFrame, block: int, aggregates: str) -> DataFrame:
    """Aggregates of all nodes: (depth, p1, p2, q1, q2: the parent's name, and the aggregates)."""
    turns = [f"t{i + 1}" for i in range(block)]
    t = blocks.sparkSession.sql(
        f"""SELECT block, before_x1, before_x2, {", ".join(turns)}, {block} - bit_count(grouping_id()) AS level, {aggregates}
        FROM {{blocks}} GROUP BY block, before_x1, before_x2, ROLLUP({", ".join(turns)})""", blocks=blocks,
    )
    last = F.get(F.array(*turns), F.col("level") - 1)
    t = t.filter(((F.col("level") > 0) & last.isNotNull()) | ((F.col("level") == 0) & (F.col("block") == 0)))  # a full block's node is not the next one's, too
    pos = lambda i: F.col("block") * block + i
    here, above = [], []
    for k in (0, 1):
        shares = [(i, F.when(F.col("level") >= i, _marks(pos(i), F.col(f"t{i}"))[k]).otherwise(0)) for i in range(1, block + 1)]
        key = F.col(f"before_x{k + 1}")
        here.append(reduce(lambda a, x: a.bitwiseXOR(x[1]), shares, key).alias(f"p{k + 1}"))
        above.append(reduce(lambda a, x: a.bitwiseXOR(F.when(F.col("level") > x[0], x[1]).otherwise(0)), shares, key).alias(f"q{k + 1}"))
    names = [c for c in t.columns if c not in {"block", "before_x1", "before_x2", "level", *turns}]
    return t.select((F.col("block") * block + F.col("level")).cast("long").alias("depth"), *here, *above, *names)


def _trie(rows: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """Nodes with conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved, n_ends, ends_sha256, tid."""
    blocks = stored(_blocks(rows, members, block), "blocks")
    nodes = stored(_rollup(blocks, block, "count(*) AS n_convs, min(conv_id) AS conv_id"), "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    # of the members of a node, conv_id is the smallest; (conv_id, depth) names the node as well
    at = rows.withColumnRenamed("pos", "depth").select("conv_id", "depth", "tid", "chars")
    nodes = nodes.join(children, NODE, "left").join(at, ["conv_id", "depth"], "left").select(
        *NODE, "q1", "q2", "conv_id", "n_convs", "tid", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0))).cast("long").alias("saved"),
    )
    nodes = stored(before(nodes, "conv_id", "depth", {"saved": ("sum", 0)}), "nodes")
    accounts = stored(nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf")).filter("saved > 0 or leaf > 0"), "accounts")
    sums = _rollup(blocks.join(accounts, "conv_id"), block, "sum(saved) AS all_saved, sum(leaf) AS n_leaves").drop("q1", "q2")
    ends = blocks.groupBy("conv_id").agg(F.sum("n").alias("depth"), F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"))
    pieces = ends.groupBy(*NODE, F.shiftright("conv_id", PIECE_BITS).alias("part")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    lists = ordered_sha256(pieces.withColumn("piece", F.array_join("ids", ",")), NODE, "part", "piece", ",")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, NODE).join(lists, NODE, "left").join(parents, ["depth", "q1", "q2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", F.col("n_convs").cast("long").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), (F.col("all_saved") - F.col("before_saved")).cast("long").alias("saved"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "tid",
    )


def prefix_trie(
    turns: DataFrame, splice: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, with_text: bool = False, block: int = BLOCK,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """A row for each distinct sequence of first turns (role, text) and for the root, depth 0: conv_id (smallest conversation that begins
    so; with depth it names the node), depth, parent_conv_id, n_convs, n_children, n_leaves (nodes without children in the subtree, itself
    included), saved (characters that sharing saves in the subtree: all but one of a node's conversations, times its last text), ends_sha256
    (of the identifiers of conversations that end here, ascending, with commas) and, if asked for, role and text of the last turn.

    Turns are ordered by turn, nulls first, then by content; null roles and texts are empty; rows without an identifier are left out, others
    may repeat and then count as often. Other columns are ignored; an empty table has no nodes. splice may rebuild conversations first.
    """
    spark = turns.sparkSession
    with scratch(spark):
        rows = turn_rows(turns, id_col, turn_col, role_col, text_col)
        rows, members = splice(rows) if splice else (rows, rows.groupBy("conv_id").agg(F.count("*").alias("n")))
        rows = stored(rows, "turns")
        nodes = _trie(rows, members, block)
        if with_text:
            role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
            texts = turns.select(digest(role, text).alias("tid"), F.struct(role.alias("role"), text.alias("text")).alias("last")).groupBy("tid").agg(F.min("last").alias("last"))
            nodes = nodes.join(stored(texts, "texts"), "tid", "left").select(*[c for c in nodes.columns if c != "tid"], "last.role", "last.text")
        else:
            nodes = nodes.drop("tid")
        return stored(nodes, "trie", outer=True)
