import corpus_pipeline
import pytest
from test_dedup import lines_by_hand
from test_near_copies import heads_by_hand
from test_text import edits, gapless

from cairn.llm import decontaminate, queries, toxicity
from cairn.llm.common import new_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The table before and after each stage."""
    docs = queries.table(spark, SF, "documents")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for before, after in list(stages.values())[:-1]:
        assert sorted(before.dtypes) == sorted(after.dtypes)


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    scores = {r.doc_id: r.predicted for r in toxicity.toxic_scores(before, queries.table(spark, SF, "labels")).collect()}
    assert set(rows(after)) == {d for d, p in scores.items() if not p}


def test_line_dedup(stages):
    before, after = (rows(x) for x in stages["line_dedup"])
    gone = lines_by_hand([(d, r.text) for d, r in before.items()], 0.8)
    assert set(before) == set(after)
    for d, r in after.items():
        assert r.text == "\n".join(x for n, x in enumerate(before[d].text.split("\n")) if (d, n) not in gone) and r.n_chars == len(r.text)


def test_simhash(stages):
    before, after = (rows(x) for x in stages["simhash"])
    assert set(after) == heads_by_hand({d: r.text for d, r in before.items()})


def test_decontamination(spark, stages):
    before, after = (rows(x) for x in stages["decontamination"])
    plain = decontaminate.plain
    items = [plain(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    for d, r in before.items():
        text = plain(r.text)
        hit = any(x in text for x in items)
        if d % 20 == 0 and not hit and len(text) < 3000:  # the whole distance is slow
            hit = any(edits(x, text) <= decontaminate.budget(x, 0.05) for x in items)
            assert (d in after) == (not hit)
        assert not hit or d not in after


def test_packing(stages):
    before, after = stages["packing"]
    packed = after.collect()
    gapless(packed, 4096)
    assert {r.doc_id for r in packed} == set(rows(before))


def test_run_leaves_nothing_but_its_result(spark, tmp_path, monkeypatch):
    """Settings are as before, and of all tables of two runs only the results stay."""
    stored = []
    monkeypatch.setattr(corpus_pipeline, "new_path", lambda s, name: stored.append(f"{tmp_path}/{name}-{len(stored)}") or stored[-1])
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", corpus_pipeline._stage(lambda s, docs, _: docs.limit(5))), ("b", corpus_pipeline._stage(lambda s, docs, _: docs))])
    names = list(corpus_pipeline.BATCHES)
    before = [spark.conf.get(n) for n in names]
    first, second = corpus_pipeline.run(spark, SF), corpus_pipeline.run(spark, SF)
    assert first.count() == second.count() == 5
    assert [spark.conf.get(n) for n in names] == before
    assert len(list(tmp_path.iterdir())) == 2
