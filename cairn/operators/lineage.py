"""Cutting lineage where a driver's loop would let it grow."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df as files in the folder of spark.checkpoint.dir, so that a lost executor costs no more than its own work. Where that is unset, a
    folder of this process if Spark runs in this machine alone, as in tests, and an error otherwise."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="cairn-"))
    return df.checkpoint()
