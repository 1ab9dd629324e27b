import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import check
from pyspark.sql import functions as F

from cairn.llm import components, exact_dedup, line_dedup, queries, simhash
from cairn.llm import words as w

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
HARD = [
    (1, "same  text\there"), (2, "same text here"), (2, "same text here"), (None, "same text here"), (3, None), (4, ""), (5, " "), (6, LONG), (7, LONG + " "),
    (8, LONG), (9, "a\nb\n\na b"), (10, "x" * 5000), (11, "A B C D e"), (12, "a b c d E"), (None, None),
]


def hard(spark):
    return spark.createDataFrame([(d, t, -1, "k", [1]) for d, t in HARD], "doc_id long, text string, keep_id long, chunks string, recipe array<int>")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    check(spark, SF, queries.QUERIES[name], queries.SQL[name])


def test_exact_dedup_of_hard_rows(spark):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in HARD]
    ids = {n: min((d for (d, _), m in zip(HARD, norm) if m == n and d is not None), default=None) for n in norm}
    want = [(d, ids[n], norm.count(n), d == ids[n], hashlib.sha256(n.encode()).hexdigest()) for (d, _), n in zip(HARD, norm)]
    got = [tuple(r)[:5] for r in exact_dedup.exact_dedup(hard(spark)).collect()]
    assert Counter(got) == Counter(want)
    assert exact_dedup.exact_dedup(hard(spark).limit(0)).count() == 0


def test_chunks_give_the_text_back_and_follow_the_content(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([(long,), ("extra start " + long,), ("",), ("x" * 1000 + " y",)], "text string")
    rows = df.select("text", exact_dedup.chunks(F.col("text"), 32).alias("c")).collect()
    assert all("".join(r.c) == r.text for r in rows)
    assert len(set(rows[0].c) & set(rows[1].c)) > 0.9 * len(set(rows[0].c))


def test_a_clash_of_identifiers_is_found(spark):
    weak = lambda c: F.encode(F.length(c).cast("string"), "UTF-8")
    piece = lambda *cs: [(str(len(c)).encode(), c) for c in cs]
    cut = spark.createDataFrame([(piece("a", "bc"),), (piece("a", "bd"),)], "pieces array<struct<id: binary, chunk: string>>")
    assert [bytes(r.id) for r in exact_dedup.clashing(cut).collect()] == [b"2"]
    want = Counter(tuple(r) for r in exact_dedup.exact_dedup(hard(spark)).collect())
    for names in [(weak, *exact_dedup.NAMES), (weak, weak, exact_dedup.NAMES[-1])]:
        assert Counter(tuple(r) for r in exact_dedup.exact_dedup(hard(spark), names=names).collect()) == want


def components_by_hand(fps, ids, bits):
    label = np.arange(len(fps))
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= bits]
    simhash.merge(label, np.array([a for a, _ in pairs], dtype=int), np.array([b for _, b in pairs], dtype=int))
    best = {}
    for d, k in zip(ids, label):
        if d is not None:
            best[k] = min(d, best.get(k, d))
    return [best.get(k) for k in label]


def test_near_classes_of_hard_rows(spark):
    fps = [simhash.fingerprint(t or "") for _, t in HARD]
    want = Counter((d, f"{f:016x}", c) for (d, _), f, c in zip(HARD, fps, components_by_hand(fps, [d for d, _ in HARD], 4)))
    assert Counter(tuple(r) for r in simhash.near_classes(hard(spark)).collect()) == want
    assert simhash.near_classes(hard(spark).limit(0)).count() == 0


def test_near_classes_of_a_table(spark):
    docs = queries.table(spark, SF, "documents")
    rows = sorted(docs.select("doc_id", "text").collect())
    fps = [simhash.fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, components_by_hand(fps, [r.doc_id for r in rows], 4))}
    assert {tuple(r) for r in queries.op2_simhash(spark, SF).collect()} == want


@pytest.mark.parametrize("block", [4096, 16])
def test_near_links_in_one_task_and_in_blocks(spark, block):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in components.components(simhash.near_links(df, 4, block)).collect()}
    got = [roots.get(f, f) for f in fps]
    want = components_by_hand(fps, list(range(len(fps))), 4)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(500, 501 + i) for i in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, **{501 + i: 500 for i in range(50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def lines_by_hand(docs, least):
    first, sets, near, occ = {}, [], set(), []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        for n, line in enumerate((t or "").split("\n")):
            if s := frozenset(line_dedup.words_of(line)):
                if s not in first:
                    first[s] = (d, n)
                    if any(len(s & o) >= least * len(s | o) - 1e-9 for o in sets):
                        near.add(s)
                    sets.append(s)
                occ.append((d, n, s))
    return {(d, n) for d, n, s in occ if first[s] != (d, n) or s in near}


@pytest.mark.parametrize("block, pairs_a_row", [(4096, 500), (8, 50), (4, 0), (2, 0)])
def test_lines_by_hand(spark, block, pairs_a_row):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 25))] for _ in range(25)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(4):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"w{rng.randint(0, 60)}"
            lines.append(" ".join(words))
        docs.append((d, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, docs[3][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, line string")
    got = {(r.doc_id if r.doc_id > -(2**63) else None, r.line_no) for r in line_dedup.removed_lines(df, block=block, pairs_a_row=pairs_a_row).collect()}
    want = lines_by_hand(docs, 0.8)
    assert got == want and want
    if block < 1024:
        return
    got = {(r.doc_id, n) for r in line_dedup.line_decisions(df).collect() for n in r.removed}
    assert got == want
    by_id = dict(docs)
    for r in line_dedup.line_dedup(df).collect():
        kept = [x for n, x in enumerate((by_id[r.doc_id] or "").split("\n")) if (r.doc_id, n) not in want]
        assert r.text == (None if by_id[r.doc_id] is None else "\n".join(kept)) and r.line == "x"


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_decisions(hard(spark).limit(0)).count() == 0


def test_words_have_codes_of_their_own(monkeypatch):
    """A word's code follows from its bytes alone, whatever its length, its place and what stands beside it."""
    rng = random.Random(4)
    lengths = [1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 72, 73, 500]
    words = {bytes(rng.choice(b"ab\0\xc3") for _ in range(k)) for k in lengths for _ in range(30)} | {b"a" + bytes(k) for k in range(80)}
    code = {x: int(w.words(x)[0][0]) for x in words}
    assert len(set(code.values())) == len(words)
    lines = [[rng.choice(sorted(words)) for _ in range(rng.randint(0, 9))] for _ in range(300)]
    data = b"\n".join(b" \t"[: rng.randint(0, 2)] + b" ".join(x) for x in lines)
    for size in (1 << 17, 100):
        monkeypatch.setattr(w, "SLICE", size)
        codes, line = w.words(data)
        assert codes.tolist() == [code[x] for l in lines for x in l]
        assert line.tolist() == [n for n, l in enumerate(lines) for _ in l]


def test_lower_bytes():
    latin = "".join(map(chr, range(256)))
    for texts in ([latin, "É", ""], [latin, "ΑΣ İ\u0130"], ["\ud800Ä"], []):
        assert w.lower_bytes(texts) == "\n".join(t.lower() for t in texts).encode("utf-8", "surrogatepass")


def test_rows_under_keys_that_nobody_asks_for_stay_in_python(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"x{i} y{i} z{i} v{j} u{j}" for j in range(5))) for i in range(40)], "doc_id long, text string")
    rank = spark.sparkContext.broadcast(np.arange(line_dedup.CELLS, dtype=np.uint64))
    sets = line_dedup.first_lines(line_dedup.all_lines(docs, rank, 0.8)).filter("size > 0")
    rows = line_dedup.keyed(sets, 0.8, 0)
    asking = rows.filter("doc_id = 7")
    got = {tuple(r) for r in line_dedup.keyed(sets, 0.8, 0, wanted=line_dedup.key_bits(asking)).collect()}
    assert got == {tuple(r) for r in rows.join(asking.select("key").distinct(), "key", "left_semi").collect()}
    assert 0 < len(got) < rows.count()
