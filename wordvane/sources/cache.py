"""A key-value cache in files: an append log of versions, last values, compaction by key buckets, get-or-fill.

    <path>/log/version=<n>        key, value of one append; writing a version again replaces it
    <path>/compact/through=<n>    the last values up to version n, in folders by bucket of the key
    <path>/ledger                 one row for each version and compaction that is complete; others aren't read

Nothing is ever rewritten: an append costs what it holds, and a reader takes the newest compaction and the versions after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordvane.sources.stores import staged

BUCKETS = 64
LEDGER = "kind string, version long"


def json_string(s: Column) -> Column:
    """A JSON string in ASCII: quotes, backslashes, control characters and DEL and everything beyond ASCII escaped."""
    out = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for raw, short in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(short))
    hex4 = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(ch: Column) -> Column:
        n = F.ascii(ch)
        pair = F.concat(hex4(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), hex4(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))))
        return F.when((n >= 32) & (n < 127), ch).when(n < 0x10000, hex4(n)).otherwise(pair)

    plain = ~out.rlike(r"[^\x20-\x7E]")
    return F.concat(F.lit('"'), F.when(plain, out).otherwise(F.array_join(F.transform(F.split(out, ""), escaped), "")), F.lit('"'))


def cache_key(df: DataFrame, prefix: str, columns: list[str]) -> Column:
    """prefix_<md5 of the JSON object of the columns, keys sorted, ", " and ": " between>. Strings, whole numbers and booleans; null is null."""
    parts = []
    for c in sorted(columns):
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType):
            value = json_string(F.col(c))
        elif isinstance(kind, (T.IntegralType, T.BooleanType)):
            value = F.col(c).cast("string")
        else:
            raise TypeError(f"{c}: keys are made of strings, whole numbers and booleans")
        parts.append(F.concat(F.lit(f'"{c}": '), F.coalesce(value, F.lit("null"))))
    return F.concat(F.lit(f"{prefix}_"), F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _last(spark: SparkSession, path: str) -> dict[str, int]:
    """The newest complete version and compaction, -1 for none: two numbers."""
    ledger = _read(spark, f"{path}/ledger", LEDGER)
    found = {} if ledger is None else {r["kind"]: r["n"] for r in ledger.groupBy("kind").agg(F.max("version").alias("n")).collect()}
    return {"log": found.get("log", -1), "compact": found.get("compact", -1)}


def _complete(spark: SparkSession, path: str, kind: str, version: int) -> None:
    spark.range(1).select(F.lit(kind).alias("kind"), F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{path}/ledger")


def put(rows: DataFrame, path: str, order: str | None = None, version: int | None = None) -> int:
    """Appends key, value and returns the version. Of a key's rows in one append the last by `order` counts, without it the greatest value.
    A version given again (a retried append) replaces what it held."""
    spark = rows.sparkSession
    n = _last(spark, path)["log"] + 1 if version is None else version
    once = rows.groupBy("key").agg(F.max_by("value", order or "value").alias("value"))
    once.write.mode("overwrite").parquet(f"{path}/log/version={n}")
    _complete(spark, path, "log", n)
    return n


def last_values(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """key, value: of each key the value of its newest version."""
    last = _last(spark, path)
    base = _read(spark, f"{path}/compact/through={last['compact']}", f"key string, value {value}, bucket int") if last["compact"] >= 0 else None
    log = _read(spark, f"{path}/log", f"key string, value {value}, version long")
    out = spark.createDataFrame([], f"key string, value {value}, version long")
    if base is not None:
        out = out.unionByName(base.select("key", "value", F.lit(last["compact"]).cast("long").alias("version")))
    if log is not None:
        done = spark.read.schema(LEDGER).parquet(f"{path}/ledger").where("kind = 'log'").select("version").distinct() if last["log"] >= 0 else None
        if done is not None:  # a row for each append
            out = out.unionByName(log.where(F.col("version") > last["compact"]).join(F.broadcast(done), "version", "left_semi").select("key", "value", "version"))
    return out.groupBy("key").agg(F.max_by("value", "version").alias("value"))


def compact(spark: SparkSession, path: str, value: str = "string", buckets: int = BUCKETS) -> int:
    """Last values as one table in folders by bucket of the key; reads give what they gave before. Returns the version it goes through."""
    n = _last(spark, path)["log"]
    rows = last_values(spark, path, value).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    rows.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/compact/through={n}")
    _complete(spark, path, "compact", n)
    return n


def get_or_fill(asked: DataFrame, path: str, fill: Callable[[DataFrame], DataFrame], value: str = "string") -> DataFrame:
    """asked with `value`: what the cache holds; where it holds nothing or an empty text, what fill() gives for these rows, which is put into the cache.

    asked has a key a row; equal keys are filled once. One join finds hits and misses. fill takes rows (a superset of columns of asked) and returns key, value.
    """
    spark = asked.sparkSession
    met = staged(asked.join(last_values(spark, path, value), "key", "left"))
    missing = F.col("value").isNull() | (F.col("value").cast("string") == "")
    filled = staged(fill(met.where(missing).drop("value").dropDuplicates(["key"])).select("key", "value"))
    if not filled.isEmpty():
        put(filled, path)
    return met.where(~missing).unionByName(met.where(missing).drop("value").join(filled, "key", "left").select(*met.columns))
