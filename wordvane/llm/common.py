"""What several operators share: staging in the shared folder, and running sums without a single hot task."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Characters that part words: the blank and the ASCII controls from tab to carriage return.
GAP = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets a temporary one;
    on a cluster that would be a folder of one machine, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            held = tempfile.mkdtemp(prefix="wordvane-")
            atexit.register(shutil.rmtree, held, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(held)
        found = held
    return found.rstrip("/")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column is called so in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(names: list[str]) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in names]


def staged(df: DataFrame, partition_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if codec:
        writer = writer.option("compression", codec)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of whole texts that go to a Python worker at once, whichever is reached first.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold BATCH_ROWS rows and about BATCH_BYTES bytes at most: both sides of a Python operator keep a
    batch of whole texts. Smaller settings of the session stay."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(re.sub(r"\D", "", conf.get(key))) <= most:
            conf.set(key, str(most))
    return df


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's rows. By Arrow: from a list Spark would start Python workers of another kind on every executor."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T._parse_datatype_string(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(fields), strict=True)], names=fields.names)
    return spark.createDataFrame(table, fields)


def word_count(text: Column) -> Column:
    """Number of words as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash01(*cols: Column, seed: str = "") -> Column:
    """A number from 0 up to 1 that depends on the values alone; md5, so that other engines can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: Copies of one row that a task writes out in a go; more are dealt to several tasks.
COPIES_EACH = 10_000


def running_sum(df: DataFrame, key: str, spot: str, order: list[str], value: str, out: str, rows_each: int = 2_000) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the same `key` that come before a row, by `spot`, then `order`.

    Equal rows are counted first (map-side, so that one row repeated a billion times is a count per task) and written out again at the
    end, in several tasks where they are many. spot lies in [0, 1) and is spread evenly over a key's different rows, so even slices of it hold about rows_each
    of them: no task gets a whole key. Sums of slices are added first (one row per slice), then the rows of each slice.
    """
    columns = df.columns
    n, slices, piece, total, start, k, piece_k = fresh([*columns, out], "_n", "_slices", "_slice", "_sum", "_start", "_k", "_s")
    rows = staged(df.groupBy(*quoted(columns)).agg(F.count(F.lit(1)).alias(n)))
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / rows_each).cast("int").alias(slices)).withColumnRenamed(key, k)
    cut = rows.join(sizes, F.col(key).eqNullSafe(F.col(k)), "left").withColumn(piece, F.floor(F.col(spot) * F.col(slices)).cast("int")).drop(k, slices)
    weight = F.col(value) * F.col(n)
    sums = cut.groupBy(key, piece).agg(F.sum(weight).alias(total))
    before = Window.partitionBy(key).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(key).alias(k), F.col(piece).alias(piece_k), F.coalesce(F.sum(total).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(key, piece).orderBy(spot, *order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(starts, F.col(key).eqNullSafe(F.col(k)) & (F.col(piece) == F.col(piece_k)), "left").drop(k, piece_k)
    found = staged(joined.withColumn(out, (F.col(start) + F.coalesce(F.sum(weight).over(inside), F.lit(0))).cast("long")).select(*quoted(columns), n, out))
    few = found.where(F.col(n) <= COPIES_EACH).withColumn(k, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    parts = found.where(F.col(n) > COPIES_EACH).withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(COPIES_EACH).cast("long")))).repartition(F.col(piece), F.col(out))
    many = parts.withColumn(k, F.explode(F.sequence(F.col(piece), F.least(F.col(piece) + COPIES_EACH, F.col(n)) - 1))).drop(piece)
    whole = few.unionByName(many).withColumn(out, F.col(out) + F.col(k) * F.col(value))
    return whole.select(*quoted(columns), out)


def meet(index: DataFrame, queries: DataFrame, keys: list[str], load, look, schema: str, tasks: int | None = None) -> DataFrame:
    """look(load(index rows as dicts), a batch of query rows) for the rows of both sides with the same keys; look yields batches of the schema.

    Rows of both sides are dealt by the keys and sorted so that a key's index rows come before its queries. A task holds one key's index
    and one batch of queries, however many queries there are; each index row moves once for each of its keys. Where work is large beside bytes, give
    the number of tasks: Spark would else put many keys together.
    """
    (side,) = fresh([*index.columns, *queries.columns], "_side")
    both = index.withColumn(side, F.lit(0)).unionByName(queries.withColumn(side, F.lit(1)), allowMissingColumns=True)
    small_batches = in_small_batches(both)
    dealt = (small_batches.repartition(tasks, *keys) if tasks else small_batches.repartition(*keys)).sortWithinPartitions(*keys, side)
    left, right = index.columns, queries.columns

    def run(batches):
        held, rows, loaded = None, [], None
        for batch in batches:
            named = list(zip(*(batch.column(k).to_pylist() for k in [*keys, side]), strict=True))
            begin = [i for i in range(len(named)) if not i or named[i] != named[i - 1]]
            for at, stop in zip(begin, [*begin[1:], len(named)], strict=True):
                *key, kind = named[at]
                part = batch.slice(at, stop - at)
                if kind == 0:
                    if key != held:
                        held, rows, loaded = key, [], None
                    rows += part.select(left).to_pylist()
                elif key == held:
                    if loaded is None:
                        loaded, rows = load(rows), []
                    yield from look(loaded, part.select(right))

    return dealt.mapInArrow(run, schema)


DOCUMENT_COLUMNS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)

#: Rows of a few numbers that may be broadcast; with more, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than so many rows; as it is otherwise. Give it a staged table: it is counted."""
    return F.broadcast(df) if df.count() <= rows else df


#: Rows of either side that one task of a pairing by shuffle gets at most, about.
PAIR_ROWS = 16_384


def paired(queries: DataFrame, parts: DataFrame, keys: list[str], most: int = 50_000, tile: int = PAIR_ROWS) -> DataFrame:
    """Every query with every part of the same keys: a stated query set against summaries of all rows. Give it staged tables: they are counted.

    Up to `most` parts are broadcast. Beyond that both sides are cut into tiles, each query goes to every tile of the parts and each part to every
    tile of the queries, and a task gets one tile of each, even where all rows have the same keys.
    """
    n = parts.count()
    if n <= most:
        return queries.join(F.broadcast(parts), keys)
    left, right = fresh([*queries.columns, *parts.columns], "_left", "_right")
    wide, high = max(1, -(-queries.count() // tile)), max(1, -(-n // tile))

    def dealt(df, own, cut, other, count):
        return df.withColumn(own, F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys and df.schema[c].dataType.typeName() != "map"]), F.lit(cut)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))

    return dealt(queries, left, wide, right, high).join(dealt(parts, right, high, left, wide), [*keys, left, right]).drop(left, right)
