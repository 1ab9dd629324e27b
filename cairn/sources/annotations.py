"""Reading and writing of annotation documents, labels, predictions and reports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.scalars import map_label


def _judged(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of documents with the columns file and _corrupt."""
    broken, keyless = F.col("_corrupt").isNotNull(), F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    bad = df.filter(broken | keyless).select("file", F.when(broken, "unreadable JSON").otherwise(f"no {key}").alias("error"))
    return df.filter(~broken & ~keyless).drop("_corrupt"), bad


def _with_corrupt(schema: T.StructType | str) -> T.StructType:
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])


def read_annotations(spark: SparkSession, path: str, schema: T.StructType | str, key: str = "video_id", one_per_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1. (good, bad) of a folder of JSON documents, one a file or (better at scale) one a line. good has a column file; bad is (file, error). Nothing fails the read."""
    df = spark.read.schema(_with_corrupt(schema)).option("multiLine", one_per_file).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return _judged(df.withColumn("file", F.col("_metadata.file_path")), key)


def parse_annotations(documents: DataFrame, schema: T.StructType | str, key: str = "video_id") -> tuple[DataFrame, DataFrame]:
    """S1. The same from rows (file, text), as read_compacted gives them."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return _judged(documents.select("file", F.from_json("text", _with_corrupt(schema), options).alias("_row")).select("_row.*", "file"), key)


MANIFEST = "file string, size long, modified timestamp, batch string"


def compact(spark: SparkSession, source: str, target: str, batch_files: int = 10_000, bytes_per_file: int = 128 << 20) -> int:
    """S1. Gathers the files of a folder, one document each, in Parquet files of about bytes_per_file under target, and returns how many files it
    has read: those that the manifest doesn't have with their present size and time of change. Files go in batches of at most
    batch_files, so many names being all that the driver holds. The manifest names a batch once it is written, so what an interrupted
    run has left counts for nothing, and the next run goes on from the batches that are named."""
    seen = F.col("_metadata")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    listed = listed.select(seen["file_path"].alias("file"), seen["file_size"].alias("size"), seen["file_modification_time"].alias("modified"))  # contents aren't read
    new, done = listed.join(manifest(spark, target).drop("batch"), ["file", "size", "modified"], "left_anti"), 0

    def write(rows: list) -> None:
        batch = uuid.uuid4().hex
        texts = spark.read.text([r.file for r in rows], wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
        parts = max(1, -(-sum(r["size"] for r in rows) // bytes_per_file))
        texts.repartition(parts, "file").write.option("compression", "zstd").parquet(f"{target}/documents/batch={batch}")
        spark.createDataFrame([(r.file, r["size"], r.modified, batch) for r in rows], MANIFEST).coalesce(1).write.mode("append").parquet(f"{target}/manifest")

    names = new.toLocalIterator()
    while rows := list(islice(names, batch_files)):
        write(rows)
        done += len(rows)
    return done


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """(file, size, modified, batch) of what compact has read; empty if there is nothing yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/manifest")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{target}/manifest")


def read_compacted(spark: SparkSession, target: str) -> DataFrame:
    """S1. (file, text) of the documents under target, each as it was when it was last read."""
    last = manifest(spark, target).groupBy("file").agg(F.max_by("batch", F.struct("modified", "size", "batch")).alias("batch"))
    if last.isEmpty():
        return spark.createDataFrame([], "file string, text string")
    rows = spark.read.schema("file string, text string, batch string").parquet(f"{target}/documents")
    return rows.join(last, ["file", "batch"]).select("file", "text")


def read_labels(spark: SparkSession, path: str, zero: Sequence[str], one: Sequence[str], key: str = "video_id", field: str = "annotation") -> DataFrame:
    """S2. (key, label, file, line_order) of JSON lines; lines that can't be read, without a key or with an unknown label are skipped.
    (file, line_order) is the order of the lines for keep_first."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_order"))
    row = lines.withColumn("r", F.from_json("value", f"`{key}` string, `{field}` string", {"mode": "PERMISSIVE"}))
    out = row.select(F.col(f"r.{key}").alias(key), map_label(F.col(f"r.{field}"), zero, one).alias("label"), "file", "line_order")
    return out.filter(F.col(key).isNotNull() & F.col("label").isNotNull())


def read_predictions(spark: SparkSession, path: str, model: str, key: str = "vid") -> DataFrame:
    """S3. (key, label, pred_<model>, wrong_<model>) of a CSV with header, with or without a byte order mark; missing columns are an error."""
    df = spark.read.csv(path, header=True)
    if missing := {key, "label", "pred", "wrong"} - set(df.columns):
        raise ValueError(f"{path} has no columns {sorted(missing)}")
    n = lambda c: F.col(c).try_cast("int")
    return df.select(F.col(key), n("label").alias("label"), n("pred").alias(f"pred_{model}"), n("wrong").alias(f"wrong_{model}"))


def write_report(df: DataFrame, path: str, by: str = "field", kind: str = "parquet", rows_per_file: int = 5_000_000) -> None:
    """S8. One table partitioned by field instead of a file for each field. Rows are dealt by field first, so that small fields get one file
    each, and a large one is split by size and by rows_per_file."""
    df.hint("rebalance", by).write.partitionBy(by).option("maxRecordsPerFile", rows_per_file).format(kind).option("header", True).save(path)


def write_features(df: DataFrame, path: str) -> None:
    """S9. (id, vector, dim, version) as Parquet."""
    df.withColumn("vector", F.col("vector").cast("array<float>")).write.parquet(path)
