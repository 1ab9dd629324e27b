"""Filtering stages judge rows, not identifiers, where these are null or repeated."""

from pyspark.sql import functions as F

from cairn.llm import decontaminate, line_dedup, packing, simhash

ITEM = "what is the name of the highest mountain on the moon"


def test_decontaminate_judges_rows(spark):
    docs = [(None, f"so {ITEM} then"), (None, "a clean text"), (7, f"{ITEM}"), (7, "another clean text"), (8, "clean too"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = decontaminate.decontaminate(df, bench)
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [d for d in docs if ITEM not in (d[1] or "")]))


def test_line_dedup_judges_rows(spark):
    docs = [(None, "one two three\nfour five six"), (None, "seven eight\nnine ten"), (3, "alpha beta\nalpha beta"), (3, "gamma\ndelta"), (4, "one two three\nepsilon"), (None, None)]
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = [(None, "one two three\nfour five six"), (None, "seven eight\nnine ten"), (3, "alpha beta"), (3, "gamma\ndelta"), (4, "epsilon"), (None, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


NAMES = ["_row", "_removed", "_removed_id", "_kept_id", "_hit_id", "row", "key", "tag", "_tag", "n", "removed", "line_no", "sid", "near", "item_id", "word"]


def wide(spark, docs):
    """docs with columns of names that operators use themselves."""
    rows = [(d, t, *(f"{i}:{n}" for n in NAMES)) for i, (d, t) in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


LONG = " ".join(f"w{i}" for i in range(60_000))
HARD = [
    (None, "one two three four five six\nlast"), (None, "one two three four five six\nlast"), (3, "alpha beta gamma delta epsilon zeta"), (3, "quite different words stand in this row"),
    (4, None), (4, ""), (5, LONG), (6, LONG + " x"), (7, f"a b c {ITEM}"), (8, " \n\n"), (9, "alpha beta gamma delta epsilon zeta"),
]


def test_stages_keep_columns_of_any_name(spark):
    df = wide(spark, HARD)
    given = {r["row"]: r for r in df.collect()}
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    lines = line_dedup.line_dedup(df).collect()
    assert sorted(r["row"] for r in lines) == sorted(given)
    texts = {int(r["row"].split(":")[0]): r.text for r in lines}
    # equal rows share their decisions; a later equal line goes; the long texts are similar lines
    assert texts[0] == texts[1] == "one two three four five six\nlast" and texts[4] is None and texts[5] == "" and texts[9] == " \n\n"
    assert {texts[2], texts[10]} == {"alpha beta gamma delta epsilon zeta", ""} and texts[3] == HARD[3][1] and sorted(map(len, (texts[6], texts[7]))) == [0, len(LONG)]
    kept = simhash.near_dedup(df).collect()
    ids = sorted(int(r["row"].split(":")[0]) for r in kept)
    assert len(ids) == 6 and {3, 6, 8} <= set(ids) and len({0, 1} & set(ids)) == 1 and len({2, 10} & set(ids)) == 1 and len({4, 5, 9} & set(ids)) == 1
    clean = decontaminate.decontaminate(df, bench).collect()
    assert sorted(r["row"] for r in clean) == sorted(r for r in given if not r.startswith("8:"))
    for out in (lines, kept, clean):
        assert all({k: v for k, v in r.asDict().items() if k != "text"} == {k: v for k, v in given[r["row"]].asDict().items() if k != "text"} for r in out)
    packed = packing.pack(df.select("*", F.length(F.coalesce("text", F.lit(""))).alias("length"), F.lit(1).alias("offset"), F.lit(2).alias("_size")).filter("length between 1 and 100"), 100).collect()
    assert len(packed) == 7 and all(r["_size"] == 2 and 0 <= r.offset < 100 for r in packed)


def test_decisions_judge_rows(spark):
    df = wide(spark, HARD)
    bench = spark.createDataFrame([(1, ITEM), (None, ITEM)], "item_id long, text string")
    got = decontaminate.contamination(df, bench).collect()
    assert sorted(map(str, [(r.doc_id, r.contaminated, r.item_ids) for r in got])) == sorted(map(str, [(d, ITEM in (t or ""), [1] if ITEM in (t or "") else []) for d, t in HARD]))
    got = line_dedup.line_decisions(df).collect()
    assert len(got) == len(HARD) and sorted(r.n_lines for r in got) == [1] * 8 + [2, 2, 3]
    assert sum(r.n_equal for r in got) == 1 and sum(r.n_near for r in got) == 1
    assert sorted(r.removed for r in got if r.doc_id == 3) in ([[], []], [[], [0]])


def test_no_rows(spark):
    df, bench = wide(spark, HARD).limit(0), spark.createDataFrame([], "item_id long, text string")
    for out in (line_dedup.line_dedup(df), simhash.near_dedup(df), decontaminate.decontaminate(df, bench)):
        assert out.columns == df.columns and out.count() == 0
    assert line_dedup.line_decisions(df).count() == 0


def test_short_items_may_be_left_out(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "x"), (3, f"see {ITEM}")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " B "), (2, ITEM)], "item_id long, text string")
    found = lambda **more: {r.doc_id: r.item_ids for r in decontaminate.contamination(docs, bench, **more).collect()}
    assert found() == {1: [1], 2: [], 3: [2]} and found(least_chars=2) == {1: [], 2: [], 3: [2]}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench, least_chars=2).collect()) == [1, 2]


def test_sample_of_labelled_rows(spark):
    """Several labels, several texts, texts that are too long or null, equal texts, held-out rows and the bound."""
    from zlib import crc32

    from cairn.llm import learn

    ids = [d for d in range(1000) if crc32(str(d).encode()) % 4 != 2][:8]
    held = next(d for d in range(1000) if crc32(str(d).encode()) % 4 == 2)
    a, b, c, d, e, f, g, h = ids
    docs = [(a, "two labels"), (b, "zz"), (b, "aa"), (c, "x" * 21), (d, None), (e, "same"), (f, "same"), (g, "no label"), (h, "null label"), (held, "held out"), (None, "nobody's")]
    labels = [(a, 0), (a, 1), (b, 0), (c, 1), (d, 1), (e, 0), (f, 1), (h, None), (held, 1), (None, 1)]
    got, counts = learn.sample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", 10, 20)
    assert got == [(a, "two labels", 1), (b, "aa", 0), (e, "same", 0)] and counts == {0: 2, 1: 4}
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    got, counts = learn.sample(many, many.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")), "toxic", 7, 20)
    assert [sum(y == k for _, _, y in got) for k in (0, 1)] == [7, 7] and sum(counts.values()) == sum(crc32(str(d).encode()) % 4 != 2 for d in range(400))
