"""Repairs the structure of conversations at least cost.

A conversation's rows and the states of the pattern (start, after system, after user, after assistant) span a lattice;
edits are its edges. Bidirectional Dijkstra searches it from both ends: one heap from the start, one from the accepting
ends. When the two frontiers' costs add up to more than the best path found, all crossings of that cost are complete, and
the one with the least audit is taken. Only a letter for each row takes part in the search; texts stay in Spark's rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import NULL_ID, real_id, scratch, stored
from cairn.llm.turns import digest, ordered_sha256, placed

DROP, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: States: 0 start, 1 after system, 2 after user, 3 after assistant; which role may come next, and where it leads.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
#: A row's letter: role (system, user, assistant, other) and fault (none, must go, truncated).
CODES = ("sSe", "uUr", "aAt", "xXo")
ROLE_OF = {code: codes[0] for codes in CODES for code in codes}
#: Letters of a conversation that are joined into one row.
PIECE = 1024


def _row_edges(code: str) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, letter of the edit) of all edits of a row."""
    role, kind = next((codes[0], codes.index(code)) for codes in CODES if code in codes)
    edges = [(q, q, DROP, "D") for q in range(4)]
    if kind == 1:
        return edges
    extra = TRUNCATED if kind == 2 else 0
    edges += [(q, NEXT[q][role], extra, "K") for q in range(4) if role in NEXT[q]]
    return edges + [(q, NEXT[q][r], REROLE + extra, "R") for q in range(4) for r in "ua" if r in NEXT[q]]


INSERTS = [(q, NEXT[q][r], INSERT, "I") for q in range(4) for r in "ua" if r in NEXT[q]]
FROM = {code: [[e[1:] for e in _row_edges(code) if e[0] == q] for q in range(4)] for code in ROLE_OF}
INTO = {code: [[(e[0], *e[2:]) for e in _row_edges(code) if e[1] == q] for q in range(4)] for code in ROLE_OF}
INSERT_FROM = [[e[1:] for e in INSERTS if e[0] == q] for q in range(4)]
INSERT_INTO = [[(e[0], *e[2:]) for e in INSERTS if e[1] == q] for q in range(4)]

# An audit under way is a linked list of its letters, (rest, letter, length): those from the start end in their last letter, those from
# the accepting ends begin with their first. Of two lists of the same cost at the same node neither begins the other: the letters say
# the states, and a letter more is an insertion, which costs.


def _less_from_start(a: tuple, b: tuple) -> bool:
    while a[2] > b[2]:
        a = a[0]
    while b[2] > a[2]:
        b = b[0]
    less = False
    while a is not b and a[2]:
        if a[1] != b[1]:
            less = a[1] < b[1]
        a, b = a[0], b[0]
    return less


def _less_from_end(a: tuple, b: tuple) -> bool:
    while a is not b and a[2] and b[2]:
        if a[1] != b[1]:
            return a[1] < b[1]
        a, b = a[0], b[0]
    return a[2] < b[2]


def _letters(a: tuple) -> list[str]:
    out = []
    while a[2]:
        out.append(a[1])
        a = a[0]
    return out


def cheapest_audit(codes: str) -> tuple[int, str]:
    """Least cost, and the ASCII-least audit of that cost, for the letters of a conversation's rows."""
    n = len(codes)
    none = (None, "", 0)
    # labels: node (row, state) -> (cost, audit); heaps: (cost, rows passed, state), so that of equal costs fewer rows come first, and a
    # label is complete when its node is taken: edges of no cost pass a row
    ahead, back = {(0, 0): (0, none)}, {(n, q): (0, none) for q in ACCEPTING}
    heap, back_heap = [(0, 0, 0)], [(0, 0, q) for q in ACCEPTING]
    heapq.heapify(back_heap)
    done: set[tuple[int, int]] = set()
    back_done: set[tuple[int, int]] = set()
    best = min((back[v][0] + c for v, (c, _) in ahead.items() if v in back), default=float("inf"))
    while heap and back_heap and heap[0][0] + back_heap[0][0] <= best:
        forward = heap[0][0] <= back_heap[0][0]
        own, other, own_heap, own_done, less = (ahead, back, heap, done, _less_from_start) if forward else (back, ahead, back_heap, back_done, _less_from_end)
        cost, passed, q = heapq.heappop(own_heap)
        i = passed if forward else n - passed
        if (i, q) in own_done:
            continue
        own_done.add((i, q))
        audit = own[i, q][1]
        steps = [(i, *e) for e in (INSERT_FROM if forward else INSERT_INTO)[q]]
        if passed < n:
            steps += [(i + 1, *e) for e in FROM[codes[i]][q]] if forward else [(i - 1, *e) for e in INTO[codes[i - 1]][q]]
        for j, p, more, letter in steps:
            node, total = (j, p), cost + more
            label = own.get(node)
            if label and (label[0] < total or node in own_done):
                continue
            new = (audit, letter, audit[2] + 1)
            if label and label[0] == total:
                if less(new, label[1]):
                    own[node] = (total, new)
                continue
            own[node] = (total, new)
            heapq.heappush(own_heap, (total, j if forward else n - j, p))
            if node in other:
                best = min(best, total + other[node][0])
    # each cheapest path leaves what the forward search has taken exactly once, unless that holds an accepting end of it
    crossings = [v for v in ahead if v in back and ahead[v][0] + back[v][0] == best and (v not in done or v[0] == n)]
    return best, min("".join(_letters(ahead[v][1])[::-1] + _letters(back[v][1])) for v in crossings)


def steps_of(codes: str, audit: str) -> list[tuple[str, str | None, int | None]]:
    """(letter, role that an edit gives, number of the row from 1) for each letter of the audit."""
    out, state, at = [], 0, 0
    for letter in audit:
        role = None
        if letter in "RI":
            role = next(r for r in "ua" if r in NEXT[state])
        if letter != "I":
            at += 1
        if letter != "D":
            state = NEXT[state][role or ROLE_OF[codes[at - 1]]]
        out.append((letter, {"u": "user", "a": "assistant"}.get(role), None if letter == "I" else at))
    return out


@lru_cache(maxsize=1 << 14)
def _short(codes: str) -> tuple[int, str]:
    return cheapest_audit(codes)


def illegal_pairs(codes: str) -> int:
    roles = [ROLE_OF[c] for c in codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def damaged(turns: DataFrame) -> DataFrame:
    """Reproducible damage of (conv_id, turn, role, text): by crc32 of `conv_id:turn`, modulo 20, a row is dropped (0), emptied (1), loses
    its full stops, exclamation and question marks (2), stands twice (3) or becomes a user's (4). Nulls are one blank."""
    kind = F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))), F.lit(20))
    t = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return t.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_")).drop("_")


def faults(rows: DataFrame) -> DataFrame:
    """rows: (conv_id, pos, role, text). Adds fault, '', 'blank', 'duplicate' or 'truncated', the first that a row has."""
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    t = rows.withColumn("_same", digest(F.col("role"), F.col("text")))
    again = t.groupBy("conv_id", "_same").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    t = t.join(again, ["conv_id", "_same"], "left")
    fault = F.when(bare == "", "blank").when(F.col("pos") > F.col("_first"), "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    return t.withColumn("fault", fault).drop("_same", "_first")


def _code() -> Column:
    role = F.substring("role", 1, 1)
    of = {r: F.lit(codes) for r, codes in zip("sua", CODES, strict=False)}
    letters = F.when(role == "s", of["s"]).when(role == "u", of["u"]).when(role == "a", of["a"]).otherwise(F.lit(CODES[3]))
    place = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 3).otherwise(1)
    return F.substr(letters, place, F.lit(1))


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (conv_id, codes), of one conversation one after the other -> its repair."""
    now, held = None, []

    def row() -> tuple:
        codes = "".join(held)
        cost, audit = _short(codes) if len(codes) <= 64 else cheapest_audit(codes)
        return now, cost, audit, illegal_pairs(codes), steps_of(codes, audit)

    columns = ["conv_id", "cost", "audit", "illegal", "steps"]
    for batch in batches:
        done = []
        for conv_id, codes in zip(batch.conv_id.tolist(), batch.codes, strict=True):
            if conv_id != now:
                if held:
                    done.append(row())
                now, held = conv_id, []
            held.append(codes)
        yield pd.DataFrame(done, columns=columns)
    if held:
        yield pd.DataFrame([row()], columns=columns)


def repairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns: (conv_id, turn, role, text) without nulls but in turn and conv_id. Returns the repair of each conversation that has rows
    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) and the repaired turns (conv_id, step, role, text, edit).

    A row is blank without any character but ASCII white space, else a duplicate if an earlier row of its conversation has its role and
    text, else truncated if its last such character is no full stop, exclamation or question mark. Keeping a row costs nothing, giving it
    the role user or assistant 3, deleting it 4 (blank rows and duplicates must go), inserting an empty user's or assistant's turn 3; a
    truncated row that stays costs 3 more. audit has a letter, K, R, D or I, for each edit: the cheapest whose roles' first letters are an
    optional s and then pairs ua, or none at all; of equal costs, the ASCII-least. Rows are ordered by turn, nulls first, then by role and
    text; roles that begin otherwise can't stay as they are. Null identifiers are one conversation. An empty table gives no rows.
    """
    rows = turns.withColumn("conv_id", F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)))
    rows = stored(faults(placed(rows, "conv_id", ["turn", "role", "text"])).withColumn("code", _code()), "faults")
    piece = F.floor((F.col("pos") - 1) / PIECE).alias("piece")
    codes = rows.groupBy("conv_id", piece).agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "code")))["code"], "").alias("codes"))
    steps = "array<struct<edit: string, given: string, pos: long>>"
    in_order = codes.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "codes")
    solved = stored(in_order.mapInPandas(_solved, f"conv_id long, cost long, audit string, illegal long, steps {steps}"), "solved")
    has = lambda fault: F.sum((F.col("fault") == fault).cast("long")).alias(fault)
    by_turn = rows.groupBy("conv_id", "turn").agg(*map(has, ("blank", "duplicate", "truncated")))
    counts = by_turn.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    )
    edits = solved.select("conv_id", F.posexplode("steps").alias("step", "x")).select("conv_id", "step", "x.*").filter("edit != 'D'")
    out = edits.join(rows.select("conv_id", "pos", "role", "text"), ["conv_id", "pos"], "left")
    out = out.select("conv_id", "step", F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")
    return counts.join(solved.drop("steps"), "conv_id"), out


def repair_report(turns: DataFrame, damage: bool = False) -> DataFrame:
    """repairs() with repaired_sha256, of the repaired rows' `role:text` with line breaks between them, for every conversation of turns, also
    those that have no rows left after damage: zeros, an empty audit and the digest of an empty text."""
    spark = turns.sparkSession
    with scratch(spark):
        rows = damaged(turns) if damage else turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
        report, repaired = repairs(rows)
        lines = repaired.withColumn("line", F.concat("role", F.lit(":"), "text"))
        whole = ordered_sha256(lines, ["conv_id"], "step", "line", "\n")
        every = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv_id")).distinct()
        out = every.join(report, "conv_id", "left").join(whole, "conv_id", "left")
        numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        out = out.select(real_id("conv_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
        return stored(out, "repairs", outer=True)
