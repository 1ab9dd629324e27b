"""Gathering of small files, reports by field, and the summary of a load."""

import json
import os
import time

from pyspark.sql import functions as F

from cairn.operators import describe as D
from cairn.sources import annotations as IO

SCHEMA = "video_id string, n int"


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_compact_reads_only_what_is_new(spark, tmp_path):
    source, target = tmp_path / "in", f"{tmp_path}/out"
    for i in range(25):
        put(source, f"d{i % 4}/{i}.json", json.dumps({"video_id": f"v{i}", "n": i}, indent=1))
    put(source, "bad.json", '{"video_id": ')
    put(source, "none.json", '{"n": 3}')
    assert IO.compact(spark, str(source), target, batch_files=10) == 27
    assert IO.compact(spark, str(source), target) == 0
    good, bad = IO.parse_annotations(IO.read_compacted(spark, target), SCHEMA)
    assert {(r.video_id, r.n) for r in good.collect()} == {(f"v{i}", i) for i in range(25)}
    assert {(os.path.basename(r.file), r.error) for r in bad.collect()} == {("bad.json", "unreadable JSON"), ("none.json", "no video_id")}
    plain_good, plain_bad = IO.read_annotations(spark, f"{source}/*", SCHEMA)
    assert plain_bad.count() == 2 and plain_good.filter("video_id = 'v3'").count() == 1
    # a changed and a new file; the others aren't read again
    put(source, "d1/1.json", '{"video_id": "v1", "n": 1000}')
    os.utime(source / "d1/1.json", (time.time() + 60, time.time() + 60))
    put(source, "x.json", '{"video_id": "x", "n": 1}')
    assert IO.compact(spark, str(source), target) == 2
    rows = {r.video_id: r.n for r in IO.parse_annotations(IO.read_compacted(spark, target), SCHEMA)[0].collect()}
    assert len(rows) == 26 and rows["v1"] == 1000 and rows["v2"] == 2
    assert IO.manifest(spark, target).select("batch").distinct().count() == 4
    # a batch that the manifest doesn't name counts for nothing
    spark.createDataFrame([("f", '{"video_id": "ghost"}')], "file string, text string").write.parquet(f"{target}/documents/batch=unfinished")
    assert IO.read_compacted(spark, target).count() == 28
    assert IO.read_compacted(spark, f"{tmp_path}/nothing").count() == 0


def test_compact_makes_few_files(spark, tmp_path):
    for i in range(60):
        put(tmp_path / "in", f"{i}.json", json.dumps({"video_id": str(i), "n": 1}))
    IO.compact(spark, f"{tmp_path}/in", f"{tmp_path}/out", bytes_per_file=500)
    files = [f for _, _, names in os.walk(tmp_path / "out/documents") for f in names if f.endswith(".parquet")]
    assert 1 < len(files) <= 5


def test_report_has_few_files_and_splits_a_hot_field(spark, tmp_path):
    df = spark.range(0, 20_000, 1, 16).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("f"), F.col("id") % 7)).otherwise("hot").alias("field"), "id")
    IO.write_report(df, f"{tmp_path}/r", rows_per_file=5000)
    count = {d.name: len([f for f in os.listdir(d) if f.endswith(".parquet")]) for d in os.scandir(tmp_path / "r") if d.is_dir()}
    assert count.pop("field=hot") >= 4 and len(count) == 7 and set(count.values()) == {1}
    assert spark.read.parquet(f"{tmp_path}/r").count() == 20_000


def test_load_is_summed_up_on_the_way(spark, tmp_path):
    rows = [("a", "1.5"), ("b", "x"), (None, "2"), ("", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, n string")
    got = {r.name: r.value for r in D.ingest(df, F.trim("k") != "", ["n"], f"{tmp_path}/good").collect()}
    assert got == {"documents_total": 5, "documents_ok": 3, "documents_bad": 2, "missing_rate.n": 2 / 3}
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/good").collect()) == ["a", "b", "c"]
    good, bad = df.filter(F.trim("k") != ""), df.filter(~F.coalesce(F.trim("k") != "", F.lit(False)))
    assert got == {r.name: r.value for r in D.ingest_summary(good, bad, ["n"]).collect()}
    none = {r.name: r.value for r in D.ingest(df.limit(0), F.lit(True), ["n"], f"{tmp_path}/none").collect()}
    assert none == {"documents_total": 0, "documents_ok": 0, "documents_bad": 0, "missing_rate.n": None}
