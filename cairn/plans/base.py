"""Where queries and their SQL are registered."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that is unset, as in tests, in one of this machine if Spark runs in it alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='cairn-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 6, cols: Sequence[str] | None = None) -> DataFrame:
    """Doubles rounded, since sums depend on the order of rows."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and (cols is None or c in cols) else F.col(c) for c, t in df.dtypes])
