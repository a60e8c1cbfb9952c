"""The corpus pipeline: language identification, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs; all but
the last return the columns of `documents`. Stages never look past their docs. Null and empty texts, repeated rows and extra
columns are taken as the operators say; extra columns, whatever they are called, come through to the last stage.

ORACLE_SQL is None: a trained network decides in the first stage, which SQL can't express; tests/llm/test_pipeline.py
holds each stage's decisions and run() against brute force; what the operators under them find is held in tests of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordvane.llm import language_id, mixing, packing, pii, shingle_join
from wordvane.llm.common import fresh, quoted, small, staged

#: Steps of score that the rejection threshold is sought in.
STEPS = 100


def least_score(docs: DataFrame, model: language_id.ByteCNN) -> float:
    """The score below which all held-out labelled rows are wrong most often beyond those right; 0 where wrong ones never prevail by three
    standard deviations, as a few rows could by chance.

    It is measured for the languages learned, whatever their number. Counts by step of score are all that comes to the driver.
    """
    rows = docs.where(language_id.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    found = language_id.predict(rows, model).groupBy(F.floor(F.col("score") * STEPS).alias("step"), (F.col("lang_pred") == F.col("lang")).alias("right")).count().collect()
    gain, seen = [0] * (STEPS + 1), [0] * (STEPS + 1)
    for r in found:
        gain[r["step"]] += -r["count"] if r["right"] else r["count"]
        seen[r["step"]] += r["count"]
    best, cut, total = 0, 0, 0
    for k, g in enumerate(gain):
        total += g
        if total > max(best, 3 * sum(seen[: k + 1]) ** 0.5):
            best, cut = total, k + 1
    return cut / STEPS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text or letters and those whose language the network can't tell; lang becomes the prediction.

    Where no network could be trained, documents with letters stay, with the lang they have or `und`.
    """
    model = language_id.fitted(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).withColumn("lang", F.coalesce("lang", F.lit(language_id.UNKNOWN))).select(*quoted(docs.columns))
    return language_id.predict(docs, model, replace=True, least=least_score(docs, model))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one of the smallest id stays, once; documents without words or ids stay as they are.

    Groups are of texts: where an id holds different texts, each is a document of its own, and only rows equal in id and text are repeats.
    """
    one, tag, key, times = fresh(docs.columns, "_one", "_tag", "_key", "_times")
    text_tag = F.xxhash64("text")
    tagged = docs.where("doc_id is not null").select(F.col("doc_id").alias(one), text_tag.alias(tag))
    clash = staged(tagged.groupBy(one).agg(F.min(tag).alias("least"), F.max(tag).alias("most")).where("least <> most").select(one))
    same_id = F.col("doc_id") == F.col(one)
    if clash.isEmpty():
        found = shingle_join.join(docs)
        # Rows that go: members that don't name their component. Row by row, for ids are held by several rows at times.
        gone = staged(found.where("component_id is not null and component_id <> doc_id").select(F.col("doc_id").alias(one)).distinct())
        kept = docs.join(small(gone), same_id, "left_anti")
    else:
        # One number for each text of each id, in the order of ids.
        keys = staged(tagged.distinct().orderBy(one, tag).withColumn(key, F.monotonically_increasing_id()))
        same = same_id & (text_tag == F.col(tag))
        found = shingle_join.join(staged(docs.select("doc_id", "text").join(small(keys), same).select(F.col(key).alias("doc_id"), "text")))
        gone = found.where("component_id is not null and component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
        kept = docs.join(small(staged(keys.join(gone, key).select(one, tag))), same, "left_anti")
    repeated = staged(kept.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias(times)).where(F.col(times) > 1).select(F.col("doc_id").alias(one)))
    if repeated.isEmpty():
        return kept
    once = kept.join(small(repeated), same_id, "left_anti")
    return once.unionByName(kept.join(small(repeated), same_id, "left_semi").dropDuplicates(["doc_id", "text"]))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every base span and accepted candidate becomes its kind in brackets."""
    return pii.redact(docs, pii.accepted_keys(staged(pii.found(docs))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: up to three times each, the last of a source cut where its target ends, others gone."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack(staged(packing.pieces(docs)))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
