"""Stages that lose no good row to a bad one: failures travel as a column, and end in a dead-letter table from which a later run takes them up again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordvane.sources.stores import staged

FAILURE = "struct<stage:string,error:string,detail:string>"


@dataclass
class Stage:
    """errors: (error class, condition on which a row fails), the first that holds counts. columns: what the stage makes, from try_ functions;
    a null in one that is `required` is a failure of class `missing:<column>`."""

    name: str
    columns: dict[str, Column] = field(default_factory=dict)
    errors: list[tuple[str, Column]] = field(default_factory=list)
    required: tuple[str, ...] = ()


@dataclass
class PythonStage:
    """column = f(input), row by row in Arrow batches; an exception is a failure of its own class name and message, and the batch goes on."""

    name: str
    column: str
    input: str
    f: Callable
    returns: str


def attempted(f: Callable, returns: str) -> Callable[[Column], Column]:
    """f as a column function: struct(value, error, detail)."""

    kind = T._parse_datatype_string(f"value {returns}, error string, detail string")

    def run(x):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        rows = []
        for item in x.to_pylist():
            try:
                rows.append({"value": f(item), "error": None, "detail": None})
            except Exception as e:  # whatever a row does, it is that row's failure
                rows.append({"value": None, "error": type(e).__name__, "detail": str(e)[:500]})
        return pa.array(rows, to_arrow_type(kind))

    return F.arrow_udf(run, kind)


def run_stages(rows: DataFrame, stages: list[Stage | PythonStage]) -> DataFrame:
    """rows with each stage's columns and `failure`, the first a row met, else null. Later stages leave a failed row alone."""
    out = rows.withColumn("failure", F.lit(None).cast(FAILURE))
    failed = F.col("failure").isNotNull()
    fails = lambda stage, error, detail=None: F.struct(F.lit(stage).alias("stage"), error.alias("error"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))
    for s in stages:
        if isinstance(s, PythonStage):
            # Failed rows have a null input; what f makes of it doesn't count.
            got = out.withColumn("_got", attempted(s.f, s.returns)(F.when(~failed, F.col(s.input))))
            bad = ~failed & F.col("_got.error").isNotNull()
            out = got.withColumn("failure", F.when(bad, fails(s.name, F.col("_got.error"), F.col("_got.detail"))).otherwise(F.col("failure")))
            out = out.withColumn(s.column, F.when(~failed, F.col("_got.value"))).drop("_got")
            continue
        found = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(error)) for error, bad in s.errors], F.lit(None).cast("string"))
        out = out.withColumn("failure", F.when(~failed & found.isNotNull(), fails(s.name, found)).otherwise(F.col("failure")))
        out = out.withColumns({c: F.when(~failed, x) for c, x in s.columns.items()}) if s.columns else out
        for c in s.required:
            out = out.withColumn("failure", F.when(~failed & F.col(c).isNull(), fails(s.name, F.lit(f"missing:{c}"))).otherwise(F.col("failure")))
    return out


def split(result: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters: keys, stage, error, detail) of one written result, so that no stage runs twice."""
    once = staged(result)
    return once.where("failure is null").drop("failure"), once.where("failure is not null").select(*keys, "failure.*")


def write_isolated(rows: DataFrame, stages: list[Stage | PythonStage], keys: list[str], good: str, dead: str, attempt: int) -> tuple[int, int]:
    """Writes good rows and dead letters of one attempt to folders of its number; running the attempt again replaces them. (good, dead) counts."""
    fine, letters = split(run_stages(rows, stages), keys)
    fine.write.mode("overwrite").parquet(f"{good}/attempt={attempt}")
    letters.write.mode("overwrite").parquet(f"{dead}/attempt={attempt}")
    return fine.count(), letters.count()


def table_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The Parquet table, or an empty one of like's columns where nothing has been written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return like.limit(0)


def to_do(source: DataFrame, keys: list[str], good: str) -> DataFrame:
    """Rows that no attempt has finished: those never met, and the dead letters."""
    return source.join(table_or_empty(source.sparkSession, good, source).select(*keys).distinct(), keys, "left_anti")


def open_letters(spark: SparkSession, keys: list[str], good: str, dead: str) -> DataFrame:
    """Of each key that no attempt has finished, its last failure."""
    letters = spark.read.parquet(dead)
    rest = [c for c in letters.columns if c not in (*keys, "attempt")]
    last = letters.groupBy(*keys).agg(F.max_by(F.struct(*rest, "attempt"), "attempt").alias("_l")).select(*keys, "_l.*")
    return last.join(table_or_empty(spark, good, letters).select(*keys).distinct(), keys, "left_anti")


def read_all(spark: SparkSession, readers: dict[str, Callable[[SparkSession], DataFrame]], columns: list[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of what the readers give, with `origin`, and of each reader that failed its error's class: one broken source stops no other."""
    found, failed = [], {}
    for name, reader in readers.items():
        try:
            found.append(reader(spark).select(*columns, F.lit(name).alias("origin")))
        except Exception as e:  # a source is lost, not the run
            failed[name] = type(e).__name__
    out = None
    for frame in found:
        out = frame if out is None else out.unionByName(frame)
    return out, failed
