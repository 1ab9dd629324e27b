import math

import pytest
from pyspark.sql import functions as F

from cairn.functions import scalars as P
from cairn.functions.stats import chi2_p_value, chi2_tail
from cairn.operators import association as A
from cairn.operators import cooccur as C
from cairn.operators import describe as D
from cairn.operators import drift as R
from cairn.operators import features as X
from cairn.operators import keys as K
from cairn.operators import metrics as M
from cairn.operators import segments as V
from cairn.operators import slices as S
from cairn.operators import telemetry as L
from cairn.sources import annotations as IO


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text, want", [("1.5", 1.5), (" 2 ", 2.0), ("NaN", None), ("x", None), ("", None), (None, None)]
)
def test_to_double(spark, text, want):
    assert one(spark, text, "string", P.to_double) == want


@pytest.mark.parametrize("text, want", [("a | b||", ["a", "b"]), ("", []), (None, None), ("a", ["a"])])
def test_split_multi(spark, text, want):
    assert one(spark, text, "string", P.split_multi) == want


@pytest.mark.parametrize("text, want", [(" Very Fast ", "very_fast"), ("横移（x）", "横移(x)"), ("a/-b", "a_b"), ("a - b", "a__b"), (None, None)])
def test_canon_token(spark, text, want):
    assert one(spark, text, "string", P.canon_token) == want


@pytest.mark.parametrize(
    "text, seconds", [("1:02:03", 3723), ("02:15", 135), ("53m 57s", 3237), ("1h 02m 03s", 3723), ("116s", 116), ("7", 7), ("soon", None), (None, None)]
)
def test_parse_duration(spark, text, seconds):
    assert one(spark, text, "string", P.parse_duration) == seconds


def test_format_duration_rounds_half_to_even(spark):
    assert [one(spark, x, "double", P.format_duration) for x in (0.5, 1.5, 61.0, 3600.0, None, float("nan"))] == ["00:00", "00:02", "01:01", "01:00:00", "", ""]


@pytest.mark.parametrize(
    "text, want",
    [
        ('<think>{"n": 9}</think> ```json\n{"n": 1,}\n```', 1), ('so {"n": 2} it is', 2), ("nothing", None), ('{"n": ', None), (None, None), ("", None),
    ],
)
def test_extract_json(spark, text, want):
    out = one(spark, text, "string", lambda c: P.extract_json(c, "n int"))
    assert out.n == want


def test_pydict_and_namespace(spark):
    assert one(spark, "x {'Auc': 0.5, 'f1': 1}", "string", P.parse_pydict) == {"auc": 0.5, "f1": 1.0}
    assert one(spark, "none", "string", P.parse_pydict) is None
    assert one(spark, "Namespace(Lr=0.1, name='a')", "string", P.parse_namespace) == {"lr": "0.1", "name": "a"}
    assert one(spark, None, "string", P.parse_namespace) is None


def test_fix_length(spark):
    f = lambda c: P.fix_length(c, 3)
    assert tuple(one(spark, [1.0, 2.0], "array<double>", f)) == ([1.0, 2.0, 0.0], [1, 1, 0])
    assert tuple(one(spark, [float(i) for i in range(7)], "array<double>", f)) == ([0.0, 2.0, 4.0], [1, 1, 1])
    assert tuple(one(spark, None, "array<double>", f)) == ([0.0] * 3, [0, 0, 0])


def test_clamp_and_valid(spark):
    assert one(spark, ["a", "z", "b"], "array<string>", lambda c: P.clamp_list(c, ["a", "c"], {"b": "c"})) == ["a", "c"]
    assert one(spark, None, "array<string>", lambda c: P.clamp_list(c, ["a"])) == []
    assert [one(spark, x, "string", P.clamp_score) for x in ("2", "-1", "x", None, "0.4")] == [1.0, 0.0, 0.0, 0.0, 0.4]
    kind = "struct<shot_types: array<string>, camera_movements: array<string>, composition_styles: array<string>, overall_style: array<string>, editing_rhythm: string, color_tone: string, lighting_style: string, confidence_score: string>"
    assert one(spark, (["a"], ["a"], ["a"], ["a"], "x", "y", "z", "0.5"), kind, P.is_valid_annotation) is True
    assert one(spark, (["a"], [], ["a"], ["a"], "x", "y", "z", "0.5"), kind, P.is_valid_annotation) is False
    assert one(spark, None, kind, P.is_valid_annotation) is False


def test_dominant_key_first_wins_ties(spark):
    f = lambda c: P.dominant_key(c, ["a", "b"])
    assert [one(spark, m, "map<string,int>", f) for m in ({"a": 1, "b": 1}, {"b": 2, "a": 1}, {"a": 0}, {}, None)] == ["a", "b", None, None, None]


def test_missing_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, float("nan"), []), (2, " ", 1.0, ["a"])], "id int, t string, x double, l array<string>")
    got = {r.field: r.missing for r in D.missing_by_field(df).collect()}
    assert got == {"id": 0, "t": 2, "x": 1, "l": 1}
    assert {(r.id, r.field) for r in D.missing_cells(df, "id").collect()} == {(1, "t"), (1, "x"), (1, "l"), (2, "t")}
    none = df.limit(0)
    assert [r.missing_rate for r in D.missing_by_field(none).collect()] == [None] * 4
    assert D.numeric_summary(none, ["x"]).first()["count"] == 0
    assert D.value_counts(none, ["t"]).count() == 0
    assert D.top_outliers(none, ["id"], ["x"]).count() == 0


def table(spark, rows):
    return spark.createDataFrame([("f", str(i), a, b) for i, (a, b) in enumerate(rows)], "field string, value string, label0 long, label1 long")


def test_chi_square_of_published_counts(spark):
    row = A.chi_square(table(spark, [(1187, 1091), (558, 674), (65, 49)])).withColumn("p", chi2_p_value("chi2", "dof")).first()
    assert row.chi2 == pytest.approx(17.208951993809215, rel=1e-12)
    assert row.p == pytest.approx(1.8328e-4, rel=1e-4)


def test_chi_square_with_yates_and_constant_label(spark):
    assert A.chi_square(table(spark, [(10, 20), (30, 40)])).first().chi2 == pytest.approx(0.4464285714)
    assert A.chi_square(table(spark, [(10, 0), (30, 0)])).count() == 0


def test_chi2_tail_closed_forms():
    assert chi2_tail(3.0, 2) == pytest.approx(math.exp(-1.5))
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_tail(11.0704976935, 5) == pytest.approx(0.05)
    assert chi2_tail(0, 3) == 1


def test_correlations_of_constant_columns_are_null(spark):
    df = spark.createDataFrame([(float(i % 3), 1.0, i % 2) for i in range(20)], "x double, c double, y int")
    got = {r.field: r.r for r in A.point_biserial(df, ["x", "c"], "y").collect()}
    assert got["c"] is None and got["x"] is not None
    assert A.point_biserial(df.limit(5), ["x"], "y").count() == 0
    assert {r.field: r.rho for r in A.spearman(df, ["c"], "y").collect()} == {"c": None}
    assert A.cramers_v(df, "c", "y").first().v is None


def test_metrics_of_a_published_confusion(spark):
    cells = [(0, 0, 167), (0, 1, 71), (1, 0, 15), (1, 1, 289)]
    rows = [("m", y, p) for y, p, n in cells for _ in range(n)]
    preds = spark.createDataFrame(rows, "model string, label int, pred int")
    b, m = M.binary_metrics(preds).first(), M.macro_metrics(preds, 5).first()
    assert (round(b.auc, 5), round(b.f1, 5), m.f1) == (0.82617, 0.87048, 0.83286)


def test_metrics_without_a_class(spark):
    preds = spark.createDataFrame([("m", 0, 0)], "model string, label int, pred int")
    b = M.binary_metrics(preds).first()
    assert (b.auc, b.f1, b.recall, b.precision, b.acc) == (None, 0.0, 0.0, 0.0, 1.0)


def test_psi_of_equal_sides_is_zero_and_constant_reference_works(spark):
    rows = [(d, "f", float(i)) for d in ("a", "b") for i in range(100)] + [("a", "c", 1.0), ("b", "c", 1.0), ("b", "c", None)]
    long = spark.createDataFrame(rows, "dataset string, field string, x double")
    assert {r.field: round(r.psi, 9) for r in R.psi_numeric(long, "a", "b").collect()} == {"f": 0.0, "c": 0.0}
    assert {r.field: r.ks for r in R.ks_2samp(long, "a", "b").collect()}["f"] == 0


def test_long_form_equals_field_by_field(spark):
    rows = [(d, f, float((i * k) % 37)) for d, k in (("a", 5), ("b", 7)) for f in ("x", "y") for i in range(200)]
    long = spark.createDataFrame(rows, "dataset string, field string, x double")
    for op in (R.psi_numeric, R.ks_2samp, R.wasserstein):
        whole = {tuple(r) for r in op(long, "a", "b").collect()}
        assert whole == {tuple(r) for f in ("x", "y") for r in op(long.filter(F.col("field") == f), "a", "b").collect()}


def test_keep_first_and_reconcile(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), (None, 1, "null")], "k string, o int, v string")
    assert {(r.k, r.v) for r in K.keep_first(df, ["k"], ["o"]).collect()} == {("a", "early"), (None, "null")}
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    out = spark.createDataFrame([("a", True), ("b", False), ("z", False)], "k string, ok boolean")
    r = K.reconcile(items, out, "k", F.col("ok")).first()
    assert (r.outputs, r.matched, r.unprocessed, r.invalid, r.orphan, r.anomalies, r.estimate) == (3, 2, 1, 2, 1, 3, 4)
    assert K.reconcile(items.limit(0), out.limit(0), "k", F.col("ok")).first().outputs == 0


def test_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 1, 2, 3, 10)] + [(None,)], "x double")
    assert [r.bin for r in S.cut(df, "x", 3).orderBy("x").collect()] == [None, 0, 0, 0, 0, 0, 2]
    assert {r.bin for r in S.qcut(df, "x", 4).collect()} == {None, 0, 1, 2} - set()
    assert {r.bin for r in S.qcut(df, "x", 3, ["low", "mid", "high"]).collect()} <= {None, "low", "mid", "high"}
    same = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r.bin for r in S.cut(same, "x", 3).collect()] == [1, 1]
    assert [r.bin for r in S.cut(same, "x", 4).collect()] == [1, 1]


def test_training_log(spark):
    text = """Namespace(dataset='d', lr=0.1)
data load time: 11.02
Epoch 0/29
TRAIN
100%|###| 20/20 [06:21<00:00, 1s/it]
100%|###| 20/20 [09:99<00:00]
VAL
100%|###| 5/5 [00:07<00:00]
{'auc': 0.5, 'f1': 0.7}
100%|###| 5/5 [00:09<00:00]
Epoch 1/29
TRAIN
100%|###| 20/20 [01:00<00:00]
early stop at epoch 1
Training complete in 53m 57s
Testing complete in 1m 55s"""
    lines = spark.createDataFrame([("r", i, x) for i, x in enumerate(text.split("\n"))], "run string, line_no int, line string")
    out = L.parse_training_log(lines)
    assert {(r.epoch, r.train_sec, r.val_sec) for r in out["epochs"].collect()} == {(0, 381, 7), (1, 60, None)}
    run = out["run"].first()
    assert (run.data_load_sec, run.early_stop, run.training_sec, run.testing_sec, run.last_unassigned_sec) == (11.02, 1, 3237, 115, 9)
    rows = {r.epoch: r for r in L.epoch_breakdown(out["epochs"], out["run"]).collect()}
    assert (rows["ALL"].train_sec, rows["ALL"].test_sec, rows["ALL"].n_epochs, rows["ALL"].train_hms) == (441, 9, 2, "07:21")


LINES = {
    "Epoch 3/29": ("epoch", 3), "Epoch 4/29: lr=1e-4": ("epoch", 4), "  Epoch  5 / 29 [12/30]": ("epoch", 5), "Epoch 6/29abc": ("epoch", 6), "Epoch x/29": (None, None), "Epoch 4": (None, None),
    "Epochs 3/29": (None, None), "the Epoch 3/29": (None, None), "epoch 3/29": (None, None), "Epoch 3 of 4/5": (None, None), "Epoch /3": (None, None),
    "TRAIN": ("phase", None), "VAL ": ("phase", None), "TRAINING": (None, None), "train": (None, None),
    "Early stop  at epoch 6": ("stop", 6), "now: early stop at epoch 12, best 7": ("stop", 12), "early stop at epoch": (None, None), "early stop": (None, None),
    "data load time: 11.02": ("load", 11.02), "Data load time:3 s": ("load", 3.0), "my data load time: 4": (None, None),
    "Training complete in 53m 57s": ("training", 3237), "x Testing complete in 1m 55s": ("testing", 115), "100%|###| 20/20 [06:21<00:00, 1s/it]": ("bar", 381), "100%|###| done": ("bar", None),
    " 99%|## | 19/20 [06:21<00:10]": (None, None), "Namespace(a=1)": ("settings", None), "{'auc': 0.5}": ("metrics", None), "": (None, None),
}


def test_kinds_of_log_lines(spark):
    df = spark.createDataFrame([(x,) for x in LINES] + [(None,)], "line string").select("line", L.classified(F.col("line")).alias("w")).select("line", "w.*")
    got = {r.line: (r.kind, r.number if r.number is not None else r.seconds) for r in df.collect()}
    assert got == {**LINES, None: (None, None)}


def test_epoch_lines_with_text_after_the_number(spark):
    text = """Epoch 3/29
TRAIN
100%|###| 20/20 [06:21<00:00, 1s/it]
Epoch 4/29: lr=1e-4
TRAIN
100%|###| 20/20 [00:21<00:00, 1s/it]
VAL
100%|###| 20/20 [00:05<00:00, 1s/it]"""
    out = L.parse_training_log(spark.createDataFrame([("r", i, x) for i, x in enumerate(text.split("\n"))], "run string, line_no int, line string"))
    assert {(r.epoch, r.train_sec, r.val_sec) for r in out["epochs"].collect()} == {(3, 381, None), (4, 21, 5)}


def test_cuts_keep_their_gap(spark):
    df = spark.createDataFrame([("v", i, 0.9 if i in (2, 3, 5, 9) else 0.1) for i in range(12)], "k string, f long, d double")
    assert V.detect_cuts(df, "k", "f", "d", 3).first().cuts == [2, 5, 9]
    videos = spark.createDataFrame([("v", 12, 4.0), ("w", 3, 4.0)], "k string, n long, fps double")
    shots = V.cuts_to_shots(videos, V.detect_cuts(df, "k", "f", "d", 3), "k", "n", "fps")
    assert sorted((r.k, r.start, r.end) for r in shots.collect()) == [("v", 0, 1), ("v", 2, 4), ("v", 5, 8), ("v", 9, 11), ("w", 0, 2)]


def test_features(spark):
    df = spark.createDataFrame([(1, 1.0, "a", ["x"]), (2, None, "b", None), (3, -5.0, "zz", ["y", "q"])], "id int, n double, c string, l array<string>")
    scaler = X.fit_scaler(df, ["n"])
    vocab = {"c": ["unknown", "a", "b"], "l": ["unknown", "x", "y"]}
    rows = {r.id: r for r in X.feature_matrix(df, "id", scaler, vocab, ["l"]).collect()}
    assert rows[1].vector[1:] == [0, 1, 0, 0, 1, 0] and rows[2].vector[1:] == [0, 0, 1, 0, 0, 0] and rows[3].vector[1:] == [1, 0, 0, 0, 0, 1]
    assert {r.field: r.unknown for r in X.unknown_counts(df, vocab, ["l"]).collect()} == {"c": 1, "l": 1}
    empty = X.fit_scaler(df.limit(0), ["n"])["n"]
    assert (empty.mean, empty.std) == (0.0, 1.0)


def test_pmi_total_is_the_largest_count(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, tag string")
    got = {(r.a, r.b): r.value for r in C.pair_metric(C.pair_stats(rows, "k"), "pmi").collect()}
    assert got[("a", "b")] == pytest.approx(math.log(1 * 2 / (2 * 1)))


def test_sources(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for name, text in {"a": '{"video_id": "a",\n "n": 1}', "b": '{"video_id": ', "c": '{"n": 2}', "d": ""}.items():
        (docs / f"{name}.json").write_text(text)
    good, bad = IO.read_annotations(spark, str(docs), "video_id string, n int")
    assert [(r.video_id, r.n) for r in good.collect()] == [("a", 1)]
    assert bad.count() >= 2
    labels = tmp_path / "labels.json"
    labels.write_text('{"video_id": "a", "annotation": "Fake"}\n\nbroken\n{"video_id": null, "annotation": "real"}\n{"video_id": "b", "annotation": "?"}\n{"video_id": "a", "annotation": "real"}\n')
    rows = IO.read_labels(spark, str(labels), ["fake"], ["real"])
    assert [(r.video_id, r.label) for r in K.keep_first(rows, ["video_id"], ["file", "line_order"]).collect()] == [("a", 0)]
    preds = tmp_path / "p.csv"
    preds.write_text("﻿vid,label,pred,wrong\na,1,0,1\n", encoding="utf-8")
    assert IO.read_predictions(spark, str(preds), "m1").first().asDict() == {"vid": "a", "label": 1, "pred_m1": 0, "wrong_m1": 1}
    with pytest.raises(ValueError):
        (tmp_path / "q.csv").write_text("vid,label\na,1\n")
        IO.read_predictions(spark, str(tmp_path / "q.csv"), "m1")


def test_quantiles_are_exact(spark):
    """Distributed quantiles against Spark's percentile, with ties, one value, nulls and NaN."""
    import random

    from cairn.operators import ranks

    rng = random.Random(4)
    rows = [("a", round(rng.gauss(0, 3), 1)) for _ in range(700)] + [("b", 5.0)] + [("c", float(i)) for i in range(500)] + [("d", None), ("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "field string, x double").withColumn("x", P.to_double("x"))
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.field: r.q for r in ranks.quantiles(df, ["field"], at).collect()}
    want = {r.field: r.q for r in df.groupBy("field").agg(F.percentile("x", at).alias("q")).collect() if r.q}
    assert set(got) == set(want) == {"a", "b", "c"}
    for f in want:
        assert got[f] == pytest.approx(want[f], abs=1e-9)
    near = {r.field: r.q for r in ranks.quantiles(df, ["field"], at, accuracy=10_000).collect()}
    assert all(abs(a - b) <= 0.2 + (1 if f == "c" else 0) for f in want for a, b in zip(near[f], want[f]))
    assert ranks.quantiles(df.limit(0), ["field"], at).count() == 0


def test_running_totals(spark):
    from cairn.operators import ranks

    counts = spark.createDataFrame([("a", float(i), i % 3) for i in range(300)] + [("b", 1.0, 2)], "f string, x double, n long")
    ranged = ranks.running(counts, ["f"], "x", ["n"], a_range=50, parts=7)
    got = {(r.f, r.x): r for r in ranged.collect()}
    total = 0
    for i in range(300):
        total += i % 3
        r = got["a", float(i)]
        assert (r.n_upto, r.n_all, r.x_next) == (total, 300, float(i + 1) if i < 299 else None)
    assert (got["b", 1.0].n_upto, got["b", 1.0].x_next) == (2, None)


def test_pairs_that_never_meet(spark):
    """More features than are listed at first: pairs that never meet may be the strongest."""
    from math import sqrt

    sets = {k: {f"f={k % 7}", f"g={k % 11}", *(["h=1"] if k < 40 else ["h=2"])} for k in range(80)}
    rows = [(k, f) for k, fs in sets.items() for f in fs]
    n, names = 80, sorted({f for _, f in rows})
    has = {f: {k for k, g in rows if g == f} for f in names}
    phi = lambda a, b: (n * len(has[a] & has[b]) - len(has[a]) * len(has[b])) / sqrt(len(has[a]) * (n - len(has[a])) * len(has[b]) * (n - len(has[b])))
    want = sorted(((round(-abs(phi(a, b)), 9), a, b) for i, a in enumerate(names) for b in names[i + 1 :]))[:12]
    df = spark.createDataFrame(rows, "k long, feature string")
    got = [(round(-r.abs_r, 9), r.a, r.b) for r in A.binary_pair_corr(df, "k", n, 12).collect()]
    assert got == want
    first = A.binary_pair_corr(df, "k", n, 1, fields=["h", "g", "f"]).first()
    assert (first.a, first.b) == ("h=1", "h=2")


def test_a_field_of_one_side_is_left_out(spark):
    rows = [("r", "x", float(i)) for i in range(60)] + [("t", "x", float(i)) for i in range(60)] + [("r", "y", float(i)) for i in range(200)]
    assert {r.field for r in R.two_sample_summary(spark.createDataFrame(rows, "dataset string, field string, x double")).collect()} == {"x"}
