import random

import corpus_pipeline

from cairn.llm import simhash

SCHEMA = "doc_id long, text string, lang string"


def shingle_set(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else {()}


def jaccard(a, b):
    p, q = (x if isinstance(x, set) else shingle_set(x) for x in (a, b))
    return len(p & q) / len(p | q)


def heads_by_hand(texts, least=0.8):
    ids = sorted(texts)
    texts = {d: set(shingle_set(t)) for d, t in texts.items()}
    root = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if root[a] != root[b] and jaccard(texts[a], texts[b]) >= least:
                lo, hi = sorted((root[a], root[b]))
                root = {d: lo if r == hi else r for d, r in root.items()}
    return set(root.values())


def text(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def changed(rng, base, edits):
    w = base.split()
    for at in rng.sample(range(len(w)), edits):
        w[at] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_stage_takes_all_pairs_of_jaccard_08(spark):
    rng = random.Random(3)
    texts, far = {}, 0
    for n in range(60):
        base = text(rng, 200)
        texts[10 * n + 1] = base
        for k, edits in enumerate((1, 2, 3, 4, 5, 6)):
            texts[10 * n + 2 + k] = copy = changed(rng, base, edits)
            apart = (simhash.fingerprint(base) ^ simhash.fingerprint(copy)).bit_count()
            far += apart > 4 and jaccard(base, copy) >= 0.8
    assert far > 50  # near copies that four bits of four-word fingerprints leave
    docs = spark.createDataFrame([(d, t, "en") for d, t in texts.items()], SCHEMA).repartition(5)
    got = corpus_pipeline.drop_near_copies(spark, docs, None)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(heads_by_hand(texts))


def test_common_shingles_and_small_texts(spark):
    rng = random.Random(5)
    texts = {n: text(rng, rng.randrange(0, 14), 3) for n in range(300)}
    texts |= {1000 + n: "all of these texts begin with one line " + text(rng, rng.randrange(1, 60), 40) for n in range(150)}
    texts |= {2000: None, 2001: "", 2002: "A b", 2003: "a  B\n"}
    docs = spark.createDataFrame([(d, t, "en") for d, t in texts.items()], SCHEMA).repartition(3)
    got = simhash.near_dedup(docs)
    assert sorted(r.doc_id for r in got.collect()) == sorted(heads_by_hand(texts))


def test_sets_that_share_a_name_are_told_apart(spark):
    """Names of three bits clash nearly everywhere."""
    rng = random.Random(13)
    texts = {n: text(rng, 60) for n in range(40)}
    texts |= {100 + n: changed(rng, texts[n], 1) for n in range(0, 40, 3)}
    docs = spark.createDataFrame([(d, t, "en") for d, t in texts.items()], SCHEMA)
    assert sorted(r.doc_id for r in simhash.near_dedup(docs, id_bits=3).collect()) == sorted(heads_by_hand(texts))


def test_null_and_repeated_identifiers(spark):
    rng = random.Random(7)
    a, b, c, d = (text(rng, 80) for _ in range(4))
    rows = [(None, a, "1"), (None, a, "2"), (None, b, "3"), (5, b, "4"), (5, c, "5"), (5, c, "5"), (None, changed(rng, a, 1), "6"), (6, d, "7")]
    got = simhash.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    a_like = [r for r in got if r.doc_id is None]
    assert len(a_like) == 1 and jaccard(a_like[0].text, a) >= 0.8
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == sorted([(5, b), (5, c), (6, d)])


def test_no_rows(spark):
    assert simhash.near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
