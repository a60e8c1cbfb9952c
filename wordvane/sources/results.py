"""Inputs that must or may be there, files taken in order until there is enough, and outputs that say how many rows they hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wordvane.sources.layers import NESTED, flat_variants, read_jsonl
from wordvane.sources.sinks import write_csv, write_jsonl
from wordvane.sources.stores import staged

#: The numbers of one result of a run; those of the treated run have a prefix in the files.
BASELINE_FIELDS = ("rouge_mean", "rouge_var")
TREATED_FIELDS = ("rouge_mean", "rouge_l", "rouge_var")


class MissingResults(FileNotFoundError):
    pass


def _there(read: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run_results(spark: SparkSession, path: str, prefix: str = "treated_") -> DataFrame:
    """A row for each result of a run file, a JSON object that lists them; fields of the treated run are called treated_... whatever their prefix in the file."""
    fields = [*BASELINE_FIELDS, *(prefix + f for f in TREATED_FIELDS)]
    schema = f"results array<struct<article_idx:long,{','.join(f'{f}:double' for f in fields)},ell_star:int>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")
    return rows.withColumnsRenamed({prefix + f: f"treated_{f}" for f in TREATED_FIELDS})


def required(spark: SparkSession, path: str, hint: str, read: Callable[[SparkSession, str], DataFrame] = run_results) -> DataFrame:
    """What read() gives; a missing file is an error that says which step writes it."""
    found = _there(lambda: read(spark, path))
    if found is None:
        raise MissingResults(f"no results at {path}; {hint}")
    return found


def optional(spark: SparkSession, path: str, schema: str, read: Callable[[SparkSession, str], DataFrame] = run_results) -> DataFrame:
    """What read() gives; no rows of the schema where the file is missing."""
    found = _there(lambda: read(spark, path))
    return spark.createDataFrame([], schema) if found is None else found


def read_lines(spark: SparkSession, path: str, schema: str = NESTED) -> DataFrame:
    """JSON lines as read_jsonl() gives them; none where there is no file."""
    return optional(spark, path, schema, lambda s, p: read_jsonl(s, p, schema))


def first_rows_of_files(spark: SparkSession, glob: str, keep: Column, n: int) -> DataFrame:
    """n rows that pass `keep`, of the files in the order of their names, rows in the order of the file; all of them where there are fewer.

    Files are taken one after the other until there are enough: only those that are needed are read. Only numbers come to the driver.
    """
    taken, have = [], 0
    for path in sorted(spark.read.parquet(glob).inputFiles()):
        taken.append(path)
        have += spark.read.parquet(path).where(keep).count()
        if have >= n:
            break
    rows = spark.read.parquet(*taken).withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.col("_metadata.row_index"))
    return rows.where(keep).orderBy("_file", "_row").limit(n).drop("_file", "_row")


def counted(frame: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Writes and returns the number of rows written, observed on the way: the frame isn't computed again to count it."""
    seen = Observation()
    write(frame.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def csv_of_lines(spark: SparkSession, lines: str, csv: str, schema: str) -> int:
    """Nested JSON lines as a CSV row for each variant; the number of rows."""
    return counted(flat_variants(read_jsonl(spark, lines)), lambda rows: write_csv(rows, csv, schema))


def write_nested_and_flat(nested: DataFrame, lines: str, csv: str, schema: str) -> tuple[int, int]:
    """Both forms of the same records, which are computed once; the numbers of records and rows."""
    once = staged(nested)
    return counted(once, lambda rows: write_jsonl(rows, lines)), counted(flat_variants(once), lambda rows: write_csv(rows, csv, schema))


def safe_name(model: Column) -> Column:
    """A model's name as that of a file."""
    return F.replace(model, F.lit("/"), F.lit("_"))


def write_models(scored: DataFrame, folder: str, combined: str) -> dict[str, int]:
    """A CSV folder for each model, and the same rows added to the combined table; the number of rows of each model. scored has a column model.

    The input is computed once. Models whose names differ in / and _ only share a folder. A model written before is replaced in its folder; in the combined
    table its rows are added to those before.
    """
    once = staged(scored.withColumn("file", safe_name(F.col("model"))))
    writer = once.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).partitionBy("file").csv(folder)
    total = counted(once.drop("file"), lambda rows: rows.write.mode("append").parquet(combined))
    counts = {r["model"]: r["count"] for r in once.groupBy("model").count().collect()}  # a row a model
    if sum(counts.values()) != total:
        raise RuntimeError(f"{total} rows written, {sum(counts.values())} counted")
    return counts
