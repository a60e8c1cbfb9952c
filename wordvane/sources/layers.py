"""Schemas and readers of the persisted layers, and routers that choose between readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the flat variants (A), responses (B) and scored samples (C).
VARIANTS = "instance_id string, task string, variant_idx int, strategy string, base_text string, paraphrased_text string, sbert_similarity double, full_prompt string, input_text string, reference_output string"
RESPONSES = "model string, instance_id string, topic_label string, variant_idx int, strategy string, prompt string, response string, input_text string, reference_output string, judge_raw_output string, judge_score double"
SCORED = (
    "model string, instance_id string, topic_label string, n_variants int, sms double, auc_e double, trd double, kpig double, ppl_var double, bf double, ppl_var_norm double, bf_norm double, ifi_norm double, "
    "cs double, hs double, faithfulness double, human_score double, avg_length double, avg_coverage double, usd double, trd_semantic double, kpig_advanced double, diagnostic_ori double, diagnostic_ifi double, diagnostic_pri double, "
    "diagnosis string, rouge1 double, rouge2 double, rougeL double, judge_raw_outputs string, faithfulness_raw_outputs string"
)
NESTED = (
    "instance_id string, task string, base_text string, base_prompt string, metadata struct<input_text:string,reference_output:string,source:string,word_count:int,article:string,gold_summary:string,instruction:string,dialogue_id:string,choices:array<string>>, "
    "variants array<struct<variant_idx:int,paraphrased_text:string,sbert_similarity:double,strategy:string,full_prompt:string>>, n_variants_generated int, generation_time_s double, diversity struct<distinct_2:double,mean_pairwise_overlap:double,n_strategies:int>"
)
LEGACY = "input_text string, reference_output string, topic_label string"
POOL = "instruction string, complexity_level int, complexity_label string, sbert_similarity double"
REQUIRED = {VARIANTS: ("instance_id", "full_prompt", "input_text"), RESPONSES: ("model", "instance_id", "prompt", "response")}


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def read_jsonl(spark: SparkSession, path: str, schema: str = NESTED) -> DataFrame:
    """JSON lines by schema; blank and malformed lines (a cut-off tail) are left out."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", f"{schema}, _corrupt string", options).alias("r"))
    return rows.where("r._corrupt is null").select("r.*").drop("_corrupt")


def read_json_array(spark: SparkSession, path: str, schema: str = LEGACY) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: str, typed: bool = True) -> DataFrame:
    """CSV with quoted line ends; typed by schema, or all strings with empty text for null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    if typed:
        return reader.schema(schema).csv(path)
    return reader.schema(", ".join(f"{n} string" for n in names(schema))).csv(path).na.fill("")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: nested JSON lines become samples, JSON arrays are read as they are, Parquet and CSV by their own readers."""
    if path.endswith(".jsonl"):
        return samples(read_jsonl(spark, path))
    if path.endswith(".json"):
        return read_json_array(spark, path)
    if path.endswith(".csv"):
        return read_csv(spark, path, VARIANTS)
    return spark.read.parquet(path)


def samples(nested: DataFrame) -> DataFrame:
    """Instances with their usable prompts; legacy names stand in for missing ones; instances without prompts go."""
    kept = F.filter("variants", lambda v: F.coalesce(v["full_prompt"], F.lit("")) != "")
    out = nested.withColumn("variants", F.coalesce(kept, F.array())).where(F.size("variants") > 0)
    return out.select(
        "instance_id", F.col("task").alias("topic_label"), F.coalesce("metadata.input_text", "metadata.article", "base_text").alias("input_text"), F.coalesce("metadata.reference_output", "metadata.gold_summary", F.lit("")).alias("reference_output"),
        F.transform("variants", lambda v: v["full_prompt"]).alias("prompt_variants"), F.transform("variants", lambda v: v["strategy"]).alias("strategies"),
    )


def flat_variants(nested: DataFrame) -> DataFrame:
    """Layer A: a row per variant."""
    v = nested.withColumn("v", F.explode("variants"))
    return v.select("instance_id", "task", "v.variant_idx", "v.strategy", "base_text", "v.paraphrased_text", "v.sbert_similarity", "v.full_prompt", F.coalesce("metadata.input_text", "metadata.article").alias("input_text"), F.coalesce("metadata.reference_output", "metadata.gold_summary").alias("reference_output"))


def grouped_responses(responses: DataFrame) -> DataFrame:
    """Responses of each (model, instance) as lists in the order of variant_idx."""
    rows = F.array_sort(F.collect_list(F.struct("variant_idx", "prompt", "response", "strategy")))
    g = responses.groupBy("model", "instance_id").agg(rows.alias("r"), F.min_by("input_text", "variant_idx").alias("input_text"), F.min_by("reference_output", "variant_idx").alias("reference_output"))
    part = lambda name: F.transform("r", lambda x: x[name])
    return g.select("model", "instance_id", "input_text", "reference_output", part("prompt").alias("prompt_variants"), part("response").alias("precomputed_responses"), part("strategy").alias("strategies"))


def instruction_pool(pool: DataFrame) -> DataFrame:
    return pool.orderBy(F.coalesce("complexity_level", F.lit(2)), F.coalesce("sbert_similarity", F.lit(0.0)), "instruction")


def newest(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> str | None:
    """Path of the newest file that matches and is no checkpoint, by Spark's own listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime").where(~F.col("path").contains("checkpoint"))
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def check_contract(frame: DataFrame, schema: str) -> tuple[bool, list[str]]:
    """Missing and unexpected columns, no rows, nulls in required columns, gaps in variant_idx; one aggregation."""
    want, have = names(schema), frame.columns
    issues = [f"missing column {c}" for c in want if c not in have] + [f"unexpected column {c}" for c in have if c not in want]
    required = [c for c in REQUIRED.get(schema, ()) if c in have]
    counts = frame.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first()
    if not counts["_n"]:
        issues.append("no rows")
    issues += [f"{counts[c]} nulls in {c}" for c in required if counts[c]]
    if not issues and schema == RESPONSES:
        g = frame.groupBy("model", "instance_id").agg(F.min("variant_idx").alias("a"), F.max("variant_idx").alias("b"), F.count(F.lit(1)).alias("n"), F.count_distinct("variant_idx").alias("d"))
        bad = g.where("a <> 0 or b <> n - 1 or d <> n").count()
        issues += [f"{bad} groups with gaps in variant_idx"] if bad else []
    return not issues, issues
