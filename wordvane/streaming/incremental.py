"""Incremental runs by Structured Streaming: what is new is processed once, into a sink that a repeated batch leaves as it is.

    <sink>/query=<id>/batch=<n>   the rows of one batch; writing it again replaces it
    <sink>/_ledger                one row for each batch that is complete; others aren't read

The query's id is kept in its checkpoint, so a run with a new checkpoint never replaces another's batches. Nothing is kept as streaming
state: which keys have been met is asked of the sink.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordvane.sources.stores import staged

FORMATS = {"parquet": {}, "json": {}, "csv": {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}}
LEDGER = "query string, batch long, rows long"


def completed(spark: SparkSession, sink: str) -> DataFrame:
    """query, batch, rows of each complete batch; an empty table before the first."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{sink}/_ledger").dropDuplicates(["query", "batch"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def append_batch(batch: DataFrame, sink: str, query: str, n: int, format: str = "parquet") -> int:
    """Writes a batch to its folder and enters it in the ledger; returns its number of rows. A batch that is entered is left as it is."""
    spark = batch.sparkSession
    known = completed(spark, sink).where((F.col("query") == query) & (F.col("batch") == n)).first()
    if known is not None:
        return known["rows"]
    rows = staged(batch)
    rows.write.mode("overwrite").format(format).options(**FORMATS[format]).save(f"{sink}/query={query}/batch={n}")
    count = rows.count()
    spark.range(1).select(F.lit(query).alias("query"), F.lit(n).cast("long").alias("batch"), F.lit(count).cast("long").alias("rows")).coalesce(1).write.mode("append").parquet(f"{sink}/_ledger")
    return count


def read_sink(spark: SparkSession, sink: str, schema: str, format: str = "parquet") -> DataFrame:
    """The rows of complete batches, with query and batch."""
    done = completed(spark, sink)
    if done.isEmpty():
        return spark.createDataFrame([], f"{schema}, query string, batch long")
    rows = spark.read.format(format).options(**FORMATS[format]).schema(f"{schema}, query string, batch long").load(sink)
    return rows.join(F.broadcast(done.select("query", "batch")), ["query", "batch"], "left_semi")  # a row for each batch


def process_new(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, keys: list[str] | None = None, format: str = "parquet", out_schema: str | None = None) -> None:
    """Parquet files that came since the last call go through transform into the sink; with keys, rows of a key met before are dropped.

    transform keeps the keys. out_schema: the sink's columns where they differ from schema.
    """
    started, known = threading.Event(), []

    def write(batch: DataFrame, n: int) -> None:
        started.wait()
        rows = batch
        if keys:
            before = read_sink(batch.sparkSession, sink, out_schema or schema, format).where((F.col("query") != known[0]) | (F.col("batch") < n))
            rows = batch.dropDuplicates(keys).join(before.select(*keys).distinct(), keys, "left_anti")
        append_batch(transform(rows), sink, known[0], n, format)

    run = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    known.append(str(run.id))
    started.set()
    run.awaitTermination()


def upsert(batch: DataFrame, sink: str, keys: list[str], n: int) -> None:
    """Parquet versions of keyed rows: batch n is one more version of its keys. One row per key is kept; writing a batch again replaces it."""
    batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{sink}/version={n}")


def upserted(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """Of each key the row of its newest version."""
    rows = spark.read.parquet(sink)
    rest = [c for c in rows.columns if c not in (*keys, "version")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert_new(spark: SparkSession, source: str, schema: str, keys: list[str], write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Each micro-batch, one row per key, goes to `write` with its number, which makes rewriting a batch harmless; upsert() is such a `write`."""
    stream = spark.readStream.schema(schema).parquet(source)
    run = stream.writeStream.foreachBatch(lambda batch, n: write(batch.dropDuplicates(keys), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
