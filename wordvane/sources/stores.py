"""Tables written between steps, and lookups that a hot key can't slow down."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset and the master is local, an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="wordvane-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what several branches read is computed once, and lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that may be broadcast for being frequent.
FREQUENT_KEYS = 100_000


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", frequent: int = 10_000, most: int = FREQUENT_KEYS) -> DataFrame:
    """left with the columns of right, which holds a key once. Give it staged tables: left is counted and read twice.

    Keys of so many rows that there can be no more than `most` of them are joined by broadcast, so that no task gets a hot key; the rest by shuffle.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = staged(counts.where(F.col("_rows") > max(frequent, left.count() // most)).select(*keys))
    if hot.isEmpty():
        return left.join(right, keys, how)
    near = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    return left.join(F.broadcast(hot), keys, "left_semi").join(near, keys, how).unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how))
