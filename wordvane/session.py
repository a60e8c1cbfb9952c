"""One place that knows how a Spark session for this library is set up."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str | None = None, shuffle_partitions: int = 8, name: str = "wordvane") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, spark-submit's own settings hold instead."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """A table of the data set, by Spark's own reader, so that any file system Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
