"""Checks of a variant data set: findings as rows, a report for each data set, a summary that knows missing ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordvane.functions import fixed, overlap, text

#: Messages listed of each data set's warnings; all are counted.
MESSAGES = 50


def findings(nested: DataFrame, expected_instances: int, expected_variants: int) -> DataFrame:
    """task, instance_id, variant_idx, check_id, severity of records (task, instance_id, base_text, metadata, variants).

    Q01: another number of instances than expected (an error), an instance of another number of variants; Q02: similarity below the bound, or missing; Q04:
    length; Q05: a copy of the base; Q06: a prompt without the paraphrase, or still with the base text; Q07: no reference. A missing text is blank.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = nested.select("task", "instance_id", blank(F.col("base_text")).alias("base"), blank(F.coalesce("metadata.reference_output", "metadata.gold_summary")).alias("reference"), F.coalesce("variants", F.array()).alias("variants"))
    n = F.size("variants")
    of_instance = F.array_compact(F.array(F.when(n != expected_variants, "Q01"), F.when(F.col("reference") == "", "Q07")))
    none = F.lit(None).cast("int").alias("variant_idx")
    whole = rows.select("task", "instance_id", none, F.explode(of_instance).alias("check_id"), F.lit("warning").alias("severity"))
    v = rows.select("task", "instance_id", "base", F.explode("variants").alias("v")).select("task", "instance_id", "base", "v.variant_idx", blank(F.col("v.paraphrased_text")).alias("para"), F.coalesce("v.full_prompt", F.lit("")).alias("prompt"), F.coalesce("v.sbert_similarity", F.lit(0.0)).alias("sim"))
    words, base_words = text.word_count(F.col("para")), text.word_count(F.col("base"))
    copy = F.col("para") == F.col("base")
    checks = F.array_compact(F.array(
        F.when(F.col("sim") < fixed.SIMILARITY_LOW, "Q02"), F.when((words < fixed.LEAST_WORDS) | (words > 3 * base_words), "Q04"), F.when(copy, "Q05"),
        F.when(~F.col("prompt").contains(F.col("para")) | (~copy & (F.col("base") != "") & F.col("prompt").contains(F.col("base"))), "Q06"),
    ))
    each = v.select("task", "instance_id", "variant_idx", F.explode(checks).alias("check_id"), F.lit("warning").alias("severity"))
    few = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected_instances).select("task", F.lit(None).cast("string").alias("instance_id"), none, F.lit("Q01").alias("check_id"), F.lit("error").alias("severity"))
    return whole.unionByName(each).unionByName(few)


def diversity_findings(nested: DataFrame, least: float = 10) -> DataFrame:
    """Q03: instances of two variants or more whose mean word edit distance over pairs is below `least`, in the columns of findings()."""
    v = nested.select("task", "instance_id", F.posexplode("variants").alias("i", "v")).select("task", "instance_id", "i", F.coalesce("v.paraphrased_text", F.lit("")).alias("t"))
    pairs = v.join(v.select("task", "instance_id", F.col("i").alias("j"), F.col("t").alias("u")), ["task", "instance_id"]).where("i < j")
    mean = pairs.groupBy("task", "instance_id").agg(F.avg(overlap.word_levenshtein(F.col("t"), F.col("u"))).alias("d"))
    return mean.where(F.col("d") < least).select("task", "instance_id", F.lit(None).cast("int").alias("variant_idx"), F.lit("Q03").alias("check_id"), F.lit("warning").alias("severity"))


def summary(nested: DataFrame, found: DataFrame, tasks: DataFrame) -> DataFrame:
    """task, status, instances, variants, warnings, errors, passed, mean_similarity, messages of every task asked for. A task without records has status
    missing_file, one error, and hasn't passed. messages: the first fifty warnings as text, by instance, variant and check."""
    sizes = nested.select("task", F.size(F.coalesce("variants", F.array())).alias("n"), F.aggregate(F.transform(F.coalesce("variants", F.array()), lambda v: F.coalesce(v["sbert_similarity"], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x).alias("s"))
    sizes = sizes.groupBy("task").agg(F.count(F.lit(1)).alias("instances"), F.sum("n").alias("variants"), F.try_divide(F.sum("s"), F.sum("n").cast("double")).alias("mean_similarity"))
    counts = found.groupBy("task").agg(F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"), F.count(F.when(F.col("severity") == "error", 1)).alias("errors"))
    order = Window.partitionBy("task").orderBy(F.col("instance_id").asc_nulls_first(), F.col("variant_idx").asc_nulls_first(), "check_id")
    listed = found.where("severity = 'warning'").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= MESSAGES)  # limited in every task before the shuffle
    line = F.concat_ws(" ", F.col("check_id"), F.col("instance_id"), F.col("variant_idx").cast("string"))
    lines = listed.groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("m")))), lambda s: s["m"]).alias("messages"))
    out = tasks.join(sizes, "task", "left").join(counts, "task", "left").join(lines, "task", "left")
    missing, zero = F.col("instances").isNull(), lambda c: F.coalesce(c, F.lit(0))
    errors = F.when(missing, 1).otherwise(zero("errors"))
    return out.select(
        "task", F.when(missing, "missing_file").otherwise("checked").alias("status"), zero("instances").alias("instances"), zero("variants").alias("variants"), zero("warnings").alias("warnings"),
        errors.cast("long").alias("errors"), (errors == 0).alias("passed"), "mean_similarity", F.coalesce("messages", F.array().cast("array<string>")).alias("messages"),
    )


#: What a task's templates must hold, whatever the case of letters.
TEMPLATE_WORDS = {"summarization": "summar"}


def template_warnings(templates: DataFrame) -> DataFrame:
    """task, template, word of the templates (task, template) that lack the word their task asks for."""
    asked = F.lit(None).cast("string")
    for task, word in TEMPLATE_WORDS.items():
        asked = F.when(F.col("task") == task, word).otherwise(asked)
    return templates.withColumn("word", asked).where(F.col("word").isNotNull() & ~F.lower("template").contains(F.col("word")))
