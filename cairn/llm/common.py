"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a regular expression; the same set that bytes.split() uses.
SPACE = r"[\x20\x09-\x0D]"

#: Stands for a null identifier while a job runs; results give null back.
NULL_ID = -(2**63)


#: Folders of the scratch() blocks that are open, innermost last.
_open: ContextVar[tuple[str, ...]] = ContextVar("open", default=())


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="cairn-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of this process if Spark runs in this machine alone, as
    in tests, and an error otherwise: other machines couldn't read it."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dir()


def new_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A path that doesn't exist yet, in the innermost open scratch() or, if outer, in what surrounds that."""
    folders = (shared_dir(spark), *_open.get())
    return f"{folders[-2 if outer and len(folders) > 1 else -1]}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession, path: str | None = None) -> Iterator[str]:
    """Tables stored in the block go to a folder of its own, which is deleted at its end (but not if path is given): what leaves
    the block must be stored outside, with outer=True."""
    folder = path or new_path(spark, "scratch")
    token = _open.set((*_open.get(), folder))
    try:
        yield folder
    finally:
        _open.reset(token)
        if path is None:
            delete(spark, folder)


def stored(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: lineage ends there and survives lost executors."""
    path = new_path(df.sparkSession, name, outer)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a Python worker keeps between tasks, by name.
_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """make(), kept between the tasks of a worker under a name. Only the latest name's is kept."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def tidy(keep: str | None = None) -> None:
    """Gives freed memory back to the system at the end of a task: Python workers live on between tasks. What the worker keeps under other
    names than `keep` is dropped."""
    for name in [n for n in _kept if n != keep]:
        del _kept[name]
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Cells of a table of counts are sent in runs of this many.
RUN = 1 << 14


def cell_counts(rows: DataFrame, cells: int, cells_of: Callable[[Iterable], Iterator[np.ndarray]]) -> np.ndarray:
    """How often cells_of(values of the only column) names each of `cells` cells: so many numbers, whatever the size of the input."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, n = np.zeros(cells, dtype=np.int64), [], 0
        for batch in batches:
            for at in cells_of(batch.iloc[:, 0]):
                held.append(at)
                n += len(at)
                if n >= cells:
                    total += np.bincount(np.concatenate(held), minlength=cells)
                    held, n = [], 0
        if n:
            total += np.bincount(np.concatenate(held), minlength=cells)
        if total.any():
            kind = np.min_scalar_type(int(total.max()))
            yield pd.DataFrame({"run": np.arange(cells // RUN), "bytes": kind.itemsize, "n": [x.tobytes() for x in total.astype(kind).reshape(-1, RUN)]})
        tidy()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for run, size, n in zip(batch.run, batch.bytes, batch.n, strict=True):
                total[run] = total.get(run, 0) + np.frombuffer(n, dtype=f"<u{size}").astype(np.int64)
        yield pd.DataFrame({"run": list(total), "bytes": 8, "n": [x.tobytes() for x in total.values()]})

    schema = "run long, bytes int, n binary"
    out = np.zeros(cells, dtype=np.int64)
    for r in rows.mapInPandas(count, schema).repartition("run").mapInPandas(add, schema).collect():
        out[r.run * RUN : (r.run + 1) * RUN] = np.frombuffer(r.n, dtype=np.int64)
    return out


def bit_table(numbers: DataFrame, bits: int) -> np.ndarray:
    """`bits` bits as bytes: which of the numbers from 0 on are in the only column."""
    n = numbers.toDF("n").select((F.col("n") + 1).alias("n"))
    rows = n.groupBy(F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows.collect():  # at most bits / 2^15 rows of 4 KB
        part = np.frombuffer(bytes(r.bits), dtype=np.uint8)
        out[(r.bucket - 1) * 4096 :][: len(part)] = part
    return out


def has_bit(table: np.ndarray, n: np.ndarray) -> np.ndarray:
    return table[n >> 3] >> (n & 7).astype(np.uint8) & 1


def split_by_key(rows: DataFrame, keys: DataFrame, bits: int = 1 << 25) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in keys, rows whose key surely isn't), both tables with a column key. A table of bits of the keys' hashes is
    broadcast; so only the former need to be moved for a join, nearly all of them with a partner as long as keys are fewer than bits."""
    bit = F.pmod(F.xxhash64("key"), F.lit(bits))
    table = rows.sparkSession.sparkContext.broadcast(bit_table(keys.select(bit), bits))  # bits / 8 bytes

    @F.pandas_udf("boolean")
    def may(at: pd.Series) -> pd.Series:
        return pd.Series(has_bit(table.value, at.to_numpy()) != 0)

    marked = rows.withColumn("_may", may(bit))
    return marked.filter("_may").drop("_may"), marked.filter("not _may").drop("_may")


def ids_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns, as (doc_id, text): null identifiers become NULL_ID, null texts empty."""
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, a struct of docs' columns, and key, a long by which rows are told apart): the key is the identifier, or, where several
    rows have it, a number below -2^62 that follows from identifier and text. Only equal rows share it."""
    own = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), own.alias("key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    many = stored(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    if many.isEmpty():
        return rows
    hashed = F.lit(-(2**62)) - F.pmod(F.xxhash64("key", "text"), F.lit(2**61))
    return rows.join(many, "key", "left").select("row", F.when(F.col("n").isNull(), F.col("key")).otherwise(hashed).alias("key"), "text")


def real_id(col: str = "doc_id") -> Column:
    return F.when(F.col(col) != NULL_ID, F.col(col))


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the identifier as text, modulo 4: fold 2 is held out from learning."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


WORD = re.compile(r"\w+|[^\w\s]+")
