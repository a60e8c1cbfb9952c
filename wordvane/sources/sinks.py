"""Writers of layers and reports. All commit through Spark's writers; append means new files, never a rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordvane.sources.layers import flat_variants
from wordvane.sources.stores import staged


def fixed_columns(frame: DataFrame, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Exactly the schema's columns in its order; others are left out. Absent ones and nulls are what defaults has for them, else null."""
    out = []
    for name, kind in (x.split(maxsplit=1) for x in schema.split(", ")):
        value = (F.col(name) if name in frame.columns else F.lit(None)).cast(kind)
        out.append((value if defaults is None or name not in defaults else F.coalesce(value, F.lit(defaults[name]).cast(kind))).alias(name))
    return frame.select(*out)


def write_csv(frame: DataFrame, path: str, schema: str, mode: str = "overwrite") -> None:
    fixed_columns(frame, schema).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_jsonl(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    frame.write.mode(mode).json(path)


def write_both(nested: DataFrame, jsonl: str, csv: str, schema: str) -> None:
    """Nested lines and exploded rows of the same records, which are computed once."""
    once = staged(nested)
    write_jsonl(once, jsonl)
    write_csv(flat_variants(once), csv, schema)


def write_partitioned(frame: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """A folder per value; null values are left out. Rows are spread within a value by the writer's tasks."""
    frame.where(F.col(by).isNotNull()).write.mode(mode).partitionBy(by).parquet(path)


def append_rows(frame: DataFrame, path: str, schema: str) -> None:
    """Appends by schema: earlier files with other columns stay readable through merge_schema()."""
    fixed_columns(frame, schema).write.mode("append").parquet(path)


def merge_schema(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return fixed_columns(spark.read.option("mergeSchema", True).parquet(path), schema)


def pending(samples: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't stored: the whole of resuming."""
    return samples.join(stored.select(*keys).distinct(), keys, "left_anti")


def report(frame: DataFrame) -> str:
    """One row as a JSON text: for small aggregated reports."""
    return frame.select(F.to_json(F.struct(*frame.columns))).first()[0]

