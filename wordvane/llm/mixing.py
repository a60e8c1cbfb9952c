"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled but repeatable order (by md5 of seed, doc_id and size), gone through up to
MAX_PASSES times. A packet is a document, or part of one: a source's packets end where a half, a quarter, an eighth and so on of its target is
left, and 1, 2, 4 words and so on past it, so that they are single words about the target and there are few cuts. A packet's virtual
finish time is the number of its source's words up to and including it, divided by the source's target. Packets of all sources are sorted by finish
time and the order is truncated where the words of the budget (all sizes) are used up: what stands before that point is the mix,
and nothing else decides what a document is taken. A source's words differ from its target by about a word.

Plan: only (doc_id, source, size) leave the scan. Running sums are made over even slices of each source (llm.common), so that a
source with a third of all rows is no task's burden. The global sort is by ranges of finish time: at time t about t times the budget has been
sent, so even ranges of time hold even numbers of words, and no sample is needed to find their borders.

Defined cases: null and empty texts have size 0 and are never taken. A null source is a source, last in order. Sources
whose documents have no words have target 0. Repeated rows are rows of their own. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wordvane.llm.common import WORD, fresh, hash01, in_small_batches, local_rows, quoted, running_sum, small, staged, word_count

MAX_PASSES = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"
#: Words between two borders of the global order: packets of one range are sorted in one task. Sums of ranges are added up in one task,
#: so there are no more than MOST_RANGES, and larger ones beyond.
WORDS_EACH, MOST_RANGES = 200_000, 1_000_000


def numbered_sources(sized: DataFrame) -> DataFrame:
    """_source, source_size and number (from 0, by code point, null last) of each source, a written table.

    Sources may be as many as hosts: they are sorted by ranges, numbered within each, and only the ranges' counts come to the driver.
    """
    per = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    ranged = staged(per.repartitionByRange(F.col("_source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    offsets, seen = [], 0
    for part in sorted(counts):
        offsets.append((part, seen))
        seen += counts[part]
    starts = F.broadcast(local_rows(sized.sparkSession, offsets, "part int, before long"))  # a row per partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("_source").asc_nulls_last()))
    return staged(ranged.join(starts, "part").select("_source", "source_size", (F.col("before") + place - 1).alias("number")))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_PASSES) -> DataFrame:
    """_source, source_size, target of each source: shares of all sizes by weight, none above `most` times its size.

    A target is least(most * size, level * weight), with the one level at which targets sum to the total. It is sought from below: sources whose cap lies
    under the level leave what they can't take to the others, which raises it, until no more are capped. Sums are whole numbers, so that any
    order of adding gives the same level.
    """
    per = numbered_sources(sized)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")).cast("double")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    level, capped = 0.0, None
    while True:
        under = F.col("cap") / F.col("weight") < level
        r = per.agg(F.sum("source_size").alias("total"), F.sum(F.when(under, F.col("cap")).otherwise(0)).alias("held"), F.sum(F.when(under, 0.0).otherwise(F.col("weight"))).alias("open"), F.count(F.when(under, 1)).alias("n")).first()
        if not r["total"] or r["n"] == capped:
            break
        level, capped = (r["total"] - r["held"]) / r["open"], r["n"]
    return per.select("_source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def queued(documents: DataFrame, weights=WEIGHTS, most: int = MAX_PASSES, seed: str = SEED) -> DataFrame:
    """One row per document, a written table: doc_id, source, size, source_size, target, first (words of its source before it in a pass)."""
    sized = documents.select("doc_id", F.col("source").alias("_source"), word_count(F.col("text")).alias("size"))
    sized = sized.withColumn("_spot", hash01(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size"), seed=seed))
    rows = running_sum(sized, "_source", "_spot", ["doc_id", "size"], "size", "first")
    per = targets(rows, weights, most).withColumnRenamed("_source", "_key")
    found = rows.join(per, F.col("_source").eqNullSafe(F.col("_key")), "left")
    return staged(found.select("doc_id", F.col("_source").alias("source"), "size", "source_size", "target", "first"))


def schedule(rows: DataFrame, most: int = MAX_PASSES, words_each: int = WORDS_EACH) -> DataFrame:
    """The mix, from queued(): source, begin (words of the source before it, over passes), words, finish, mix_start (words before it in the global order) and `first`
    of each packet in the order of finish times up to the budget, where the last is cut.

    By time 1 + 1 / target every source has sent its whole target or more, so the budget has run out when the smallest target's source has: packets that begin later
    needn't be made.
    """
    least = rows.agg(F.sum("size").alias("budget"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("target")).first()
    budget, c = int(least["budget"] or 0), F.col
    passes = rows.where((c("size") > 0) & (c("target") > 0)).withColumn("whole", F.floor("target").cast("long")).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    passes = passes.withColumn("at", c("pass") * c("source_size") + c("first")).withColumn("end", c("at") + c("size")).where(c("at") <= c("target") * (1 + 1 / (least["target"] or 1.0)))
    halves = F.transform(F.sequence(F.lit(1), F.lit(62)), lambda j: c("whole") - F.call_function("shiftright", c("whole"), j))
    doubles = F.transform(F.sequence(F.lit(0), F.lit(61)), lambda j: c("whole") + F.call_function("shiftleft", F.lit(1).cast("long"), j))
    cuts = F.filter(F.array_distinct(F.concat(halves, doubles)), lambda x: (x > c("at")) & (x < c("end")))
    none = F.array().cast("array<bigint>")
    passes = passes.withColumn("points", F.concat(F.array("at"), F.when(c("end") <= c("whole") - F.floor(c("whole") / 2), none).otherwise(cuts)))
    parts = F.transform("points", lambda x, i: F.struct(x.alias("begin"), (F.coalesce(F.get("points", i + 1), c("end")) - x).alias("words")))
    sent = passes.withColumn("p", F.explode(parts)).select("source", "first", "p.begin", "p.words", ((c("p.begin") + c("p.words")) / c("target")).alias("finish"))
    ranges = max(1, min(MOST_RANGES, -(-budget // words_each)))
    sent = sent.withColumn("range", F.floor(F.least(c("finish"), F.lit(2.0)) * ranges).cast("int"))
    sums = sent.groupBy("range").agg(F.sum("words").alias("sum"))
    starts = sums.select("range", F.coalesce(F.sum("sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = Window.partitionBy("range").orderBy("finish", c("source").asc_nulls_last(), "begin").rowsBetween(Window.unboundedPreceding, -1)
    out = sent.join(starts, "range", "left").withColumn("mix_start", (c("start") + F.coalesce(F.sum("words").over(inside), F.lit(0))).cast("long"))
    return out.where(c("mix_start") < budget).withColumn("words", F.least(c("words"), F.lit(budget) - c("mix_start"))).select("source", "first", "begin", "words", "finish", "mix_start")


def mixed(documents: DataFrame, weights=WEIGHTS, most: int = MAX_PASSES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, first, taken, mix_start (of its first packet, null if not taken)."""
    rows = queued(documents, weights, most)
    plan = schedule(rows, most).groupBy("source", "first").agg(F.sum("words").alias("_words"), F.min("mix_start").alias("mix_start"))
    plan = plan.withColumnRenamed("source", "_src").withColumnRenamed("first", "_first")
    # Of a source's documents with words no two have the same `first`.
    found = rows.join(plan, F.col("source").eqNullSafe(F.col("_src")) & (F.col("first") == F.col("_first")) & (F.col("size") > 0), "left")
    return found.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "first", F.coalesce("_words", F.lit(0)).cast("long").alias("taken"), "mix_start")


def mixed_documents(documents: DataFrame, weights=WEIGHTS, most: int = MAX_PASSES) -> DataFrame:
    """The mix as documents, with the columns of the input, whatever they are called: each taken document once per whole time it is taken, and once with its text cut after the
    words that are left over (n_chars follows). Documents of which no word is taken go.

    Rows of one doc_id, source and size share what these are taken: each row is served by itself, so they are numbered on both sides.
    """
    columns = documents.columns
    rows = staged(mixed(documents, weights, most))
    repeats = rows.groupBy("doc_id", "source", "size").count().where("count > 1").take(1)
    doc, src, size, times, nth, words, spare = fresh(columns, "_id", "_src", "_size", "_taken", "_nth", "_words", "_spare")
    place = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.desc("taken"), "first")) if repeats else F.lit(1)
    taken = staged(rows.withColumn("nth", place).where("taken > 0").select(F.col("doc_id").alias(doc), F.col("source").alias(src), F.col("size").alias(size), F.col("taken").alias(times), F.col("nth").alias(nth)))
    full = in_small_batches(documents).withColumn(words, word_count(F.col("text")))
    # Only where ids repeat do rows with the same id, source and size have to be told apart; texts are not moved for that otherwise.
    full = full.withColumn(spare, F.row_number().over(Window.partitionBy("doc_id", "source", words).orderBy(F.xxhash64("text"))) if repeats else F.lit(1))
    kept = full.join(small(taken), F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(src)) & (F.col(words) == F.col(size)) & (F.col(spare) == F.col(nth)))
    schema = T.StructType([documents.schema[c] for c in columns])

    def copies(batches):
        import re

        import numpy as np
        import pyarrow as pa

        word = re.compile(WORD)
        for batch in batches:
            total, n = (batch.column(k).to_numpy() for k in (times, size))
            yield batch.select(columns).take(pa.array(np.repeat(np.arange(batch.num_rows), total // n)))
            rest = np.flatnonzero(total % n)
            if len(rest):
                part = batch.select(columns).take(pa.array(rest))
                texts = []
                for text, k in zip(part.column(columns.index("text")).to_pylist(), (total % n)[rest], strict=True):
                    found = word.finditer(text)
                    for _ in range(int(k)):
                        m = next(found)
                    texts.append(text[: m.end()])
                new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
                yield pa.RecordBatch.from_arrays([new[c].cast(f.type) if (c := f.name) in new else part.column(i) for i, f in enumerate(part.schema)], names=columns)

    return kept.select(*quoted(columns), times, size).mapInArrow(copies, schema)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, first, mix_start of every row of `documents`."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = """
with s as (select doc_id, source, size, md5(concat_ws('|', 'mix', coalesce(cast(doc_id as varchar), 'null'), cast(size as varchar))) as h from (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from documents)),
per as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from s group by source),
caps as (select *, 3.0::double * source_size as cap, 3.0::double * source_size / weight as ratio, (sum(source_size) over ())::double as total from per),
lev as (select *, (total - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from caps),
tgt as (select source, source_size, coalesce(least(cap, weight * max(case when level <= ratio then level end) over ()), 0.0) as target from lev),
r as (select s.*, t.source_size, t.target, coalesce(sum(size) over (partition by s.source order by substr(h, 1, 8), doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as first from s join tgt t on s.source is not distinct from t.source),
p as (select source, first, target, floor(target)::bigint as whole, k.pass * source_size + first as at_, k.pass * source_size + first + size as fin from r, (select unnest([0, 1, 2]) as pass) k where size > 0 and target > 0),
q as (select *, [at_] || list_sort(list_filter(list_distinct(list_transform(range(1, 63), lambda j: whole - (whole >> j)) || list_transform(range(0, 62), lambda j: whole + (1::bigint << j))), lambda x: x > at_ and x < fin)) || [fin] as points from p),
f as (select source, first, target, points[i] as begin, points[i + 1] - points[i] as words from (select *, unnest(range(1, len(points))) as i from q)),
m as (select source, first, words, coalesce(sum(words) over (order by (begin + words)::double / target, source nulls last, begin rows between unbounded preceding and 1 preceding), 0)::bigint as mix_start from f),
t as (select source, first, sum(least(words, b.budget - mix_start))::bigint as taken, min(mix_start) as mix_start from m, (select sum(size) as budget from s) b where mix_start < b.budget group by all)
select r.doc_id, r.size, r.source_size, r.target::double as target, coalesce(t.taken, 0)::bigint as taken, r.source, r.first, t.mix_start
from r left join t on r.source is not distinct from t.source and r.first = t.first and r.size > 0
"""
