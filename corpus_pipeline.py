"""A training corpus from documents: toxic documents go, later lines go, one of each near-duplicate group stays,
documents with benchmark items go, and the rest is packed."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, line_dedup, packing, simhash, toxicity
from cairn.llm.common import delete, new_path, scratch
from cairn.llm.queries import table, word_bpe


#: What a Python worker gets at a time: texts and sets of shingles may be long, and a worker holds a batch in several forms.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: The folder with the tables that the latest stage of a run has stored: of run(), or else of the stages called in a session.
_of_run: ContextVar[list[str] | None] = ContextVar("of_run", default=None)
_of_session: WeakKeyDictionary[SparkSession, list[str]] = WeakKeyDictionary()


def _stage(f: Callable) -> Callable:
    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str | None) -> DataFrame:
        """A stage's result has been written before the next one begins, which then deletes what the former has stored. Its batches are
        bounded by settings of the session, which the result needs until it has been written; run() restores them."""
        for name, value in BATCHES.items():
            spark.conf.set(name, value)
        left = _of_run.get()
        if left is None:
            left = _of_session.setdefault(spark, [])
        while left:
            delete(spark, left.pop())
        left.append(new_path(spark, f.__name__))
        with scratch(spark, left[-1]):
            return f(spark, docs, sf_dir)

    return stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the raw documents' labels and judges every text that reaches this stage."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


@_stage
def drop_later_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard similarity 0.8 or more; op2_simhash has the parameters of its contract."""
    return simhash.near_dedup(docs)


@_stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, word_bpe(), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_later_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: A trained model and bit-parallel matching have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep, read from the table that the last one has written. What the stages have stored on the way
    is deleted, and the session's settings are as before."""
    settings = {name: spark.conf.get(name) for name in BATCHES}
    left: list[str] = []
    token = _of_run.set(left)
    docs, before = table(spark, sf_dir, "documents"), None
    try:
        for name, stage in STAGES:
            path = new_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            if before:
                delete(spark, before)
            docs, before = spark.read.parquet(path), path
    finally:
        _of_run.reset(token)
        for folder in left:
            delete(spark, folder)
        for name, value in settings.items():
            spark.conf.set(name, value)
    return docs
