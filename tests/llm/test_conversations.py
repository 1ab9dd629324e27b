"""The prefix trie and the repair of conversations, against brute force and SQL."""

import hashlib
import random
import zlib
from functools import cache

import pytest
from oracle import check
from pyspark.sql import functions as F

from cairn.llm import prefix_trie, queries, repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_repair"])
def test_same_rows_as_sql(spark, name):
    check(spark, SF, queries.QUERIES[name], queries.SQL[name])


def sequences(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [v[2:] for v in sorted(rows, key=lambda v: v[:2])] for c, rows in convs.items()}


def brute_trie(seqs):
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = set()
    for path, convs in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        kids = lambda q: [p for p in nodes if len(p) == len(q) + 1 and p[: len(q)] == q]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in under if p)
        ends = ",".join(map(str, sorted(c for c in convs if len(seqs[c]) == len(path))))
        parent = min(nodes[path[:-1]]) if path else None
        out.add((min(convs), len(path), parent, len(convs), len(kids(path)), sum(not kids(p) for p in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]


def made(seed, n=60, words=("a", "bb", "ccc")):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", "", None]), rng.choice([*words, "", None])) for c in range(n) for t in range(rng.choice([1, 2, 3, 9, 17, 20]))]
    rows += [(1000 + c, t, "user", f"long {t}") for c in range(3) for t in range(40 + c)] + [(2000, None, "user", "first"), (2000, 0, "user", "second"), (None, 1, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [2, 8])
def test_trie_is_that_of_brute_force(spark, block):
    rows = made(block)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("another column")).withColumn("n", F.lit(1))
    got = prefix_trie.prefix_trie(df, block=block)
    assert {tuple(r[c] for c in COLUMNS) for r in got.collect()} == brute_trie(sequences(rows))


def test_trie_of_rebuilt_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, "user", rng.choice("xy")) for c in [*range(0, 12), *range(100, 130), 205, 317] for t in range(rng.randint(1, 7))]
    rows += [(c, 0, "user", "x") for c in range(401, 420)]  # nothing to take turns from
    seqs = sequences(rows)
    cut = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        cut[c] = seqs.get(c - c % 100, [])[:h] + own[h:]
    assert any(not s for s in cut.values())  # some are left without turns
    own = F.col("conv_id")
    splice = lambda r: prefix_trie.spliced(r, own - own % 100, F.pmod(F.crc32(own.cast("string")), F.lit(6)), 5)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), splice)
    assert {tuple(r[c] for c in COLUMNS) for r in got.collect()} == brute_trie(cut)


def test_trie_with_text_and_without_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "ho")], SCHEMA)
    got = {(r.conv_id, r.depth, r.role, r.text, r.n_convs) for r in prefix_trie.prefix_trie(df, with_text=True).collect()}
    assert got == {(1, 0, None, None, 2), (1, 1, "user", "hi", 2), (2, 2, "assistant", "ho", 1)}
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


# repair ------------------------------------------------------------------------------------------------------------------------


def brute_repair(rows):
    """rows: (role, text, fault) in order. (cost, audit, repaired lines) by trying all edits, with at most two insertions in a row."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @cache
    def best(i, q, ins):
        found = [(0, "", ())] if i == len(rows) and q in (0, 3) else []

        def go(cost, letter, j, p, line, n):
            c, a, out = best(j, p, n)
            found.append((cost + c, letter + a, ((line,) if line is not None else ()) + out))

        if ins < 2:
            for r in ("user", "assistant"):
                if (q, r[0]) in step:
                    go(3, "I", i, step[q, r[0]], f"{r}:", ins + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(4, "D", i + 1, q, None, 0)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (q, role[:1]) in step:
                    go(more, "K", i + 1, step[q, role[:1]], f"{role}:{text}", 0)
                for r in ("user", "assistant"):
                    if (q, r[0]) in step:
                        go(3 + more, "R", i + 1, step[q, r[0]], f"{r}:{text}", 0)
        return min(found, default=(10**6, "", ()))

    return best(0, 0, 0)


def brute_report(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own, seen, judged = sorted(((t is not None, t or 0, r or " ", x or " ") if x != "" else (t is not None, t or 0, r or " ", "") for k, t, r, x in rows if k == c)), set(), []
        turns = [t for known, t, *_ in own if known]
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        cost, audit, lines = brute_repair(tuple(judged))
        count = lambda f: sum(x[2] == f for x in judged)  # noqa: B023, E731
        initials = [r[:1] for r, _, _ in judged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_is_that_of_brute_force(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "half", "", " \n", None, "So? ", "x\x0b", "é"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), rng.choice(texts)) for c in [None, *range(80)] for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"pos": F.lit("x"), "fault": F.lit(1)})
    got = {r.conv_id: tuple(r[c] for c in REPORT) for r in repair.repair_report(df).collect()}
    assert got == brute_report(rows)
    assert repair.repair_report(df.limit(0)).count() == 0


def test_search_is_that_of_brute_force():
    rng = random.Random(7)
    letter = {("system", ""): "s", ("system", "blank"): "S", ("system", "truncated"): "e", ("user", ""): "u", ("user", "blank"): "U", ("user", "truncated"): "r"}
    letter |= {("assistant", ""): "a", ("assistant", "blank"): "A", ("assistant", "truncated"): "t", ("tool", ""): "x", ("tool", "blank"): "X", ("tool", "truncated"): "o"}
    for _ in range(3000):
        rows = tuple((role, "t", fault) for role, fault in rng.choices(list(letter), k=rng.randint(0, 14)))
        codes = "".join(letter[r, f] for r, _, f in rows)
        cost, audit, lines = brute_repair(rows)
        assert repair.cheapest_audit(codes) == (cost, audit)
        steps = repair.steps_of(codes, audit)
        assert [f"{role or rows[at - 1][0]}:{rows[at - 1][1] if at else ''}" for edit, role, at in steps if edit != "D"] == list(lines)


def test_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(5000)] + [(1, 5000, "tool", "odd")]
    got = repair.repair_report(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got.cost, got.audit, got.truncated, got.illegal) == (4, "K" * 5000 + "D", 1, 1)
    assert got.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in rows[:-1]).encode()).hexdigest()


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two? Three!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = {}
    for r in repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (role or " ", text or " ")
        want = {0: None, 1: [(row[0], "")], 2: [(row[0], row[1].replace(".", "").replace("?", "").replace("!", ""))], 3: [row, row], 4: [("user", row[1])]}.get(kind, [row])
        assert got.get((c, t)) == want
