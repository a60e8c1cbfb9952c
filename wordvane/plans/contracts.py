"""Reports on a variant data set and files of results.

A conversation is an instance of one of three tasks (a fourth has no file), its first turn the base text, its later turns the variants. Every fifth variant's
prompt still holds the base text, some prompts lack the paraphrase, some variants have no similarity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordvane.operators import validation
from wordvane.plans.catalog import query
from wordvane.plans.dialogue import WORDS, turns
from wordvane.plans.durability import folder
from wordvane.plans.measures import SCORED, scored
from wordvane.session import table
from wordvane.sources import results
from wordvane.sources.stores import lookup, staged

TASKS = ("summarization", "creative", "dialogue", "qa")
INSTANCES, VARIANTS = 7, 4


def nested(spark, sf_dir) -> DataFrame:
    t = turns(spark, sf_dir)
    base = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("base"), F.min("turn").alias("t0"))
    k, prompt = F.col("turn"), lambda x: F.concat(F.lit("Reply: "), x)
    v = t.join(base, "conv_id").withColumn("v", F.when(k > F.col("t0"), F.struct(
        k.cast("int").alias("variant_idx"), F.col("text").alias("paraphrased_text"), F.when(k % 7 != 5, 0.7 + (k % 4) * F.lit(0.08)).alias("sbert_similarity"), F.lit("s").alias("strategy"),
        F.when(k % 5 == 2, prompt(F.col("base"))).when(k % 6 == 4, "Reply: nothing").otherwise(prompt(F.col("text"))).alias("full_prompt"),
    )))
    g = v.groupBy("conv_id").agg(F.first("base").alias("base_text"), F.array_sort(F.collect_list("v")).alias("variants"))  # an instance is one record
    task = F.element_at(F.array(*[F.lit(x) for x in TASKS[:3]]), (F.col("conv_id") % 3 + 1).cast("int"))
    meta = F.struct(F.when(F.col("conv_id") % 5 != 1, F.col("base_text")).alias("reference_output"), F.lit(None).cast("string").alias("gold_summary"))
    return g.select(task.alias("task"), F.format_string("inst_%04d", "conv_id").alias("instance_id"), "base_text", meta.alias("metadata"), "variants")


FOUND = f"""b as (select conv_id, (['summarization', 'creative', 'dialogue'])[conv_id % 3 + 1] as task, printf('inst_%04d', conv_id) as instance_id, arg_min(text, turn) as base0, trim(arg_min(text, turn)) as base, min(turn) as t0, count(*) - 1 as k from conversations group by conv_id),
v as (select b.*, c.turn::int as idx, trim(c.text) as para, case when c.turn % 5 = 2 then 'Reply: ' || base0 when c.turn % 6 = 4 then 'Reply: nothing' else 'Reply: ' || c.text end as prompt, case when c.turn % 7 <> 5 then 0.7 + (c.turn % 4) * 0.08::double else 0 end as sim from b join conversations c on c.conv_id = b.conv_id and c.turn > b.t0),
w as (select *, len({WORDS.format('para')}) as n, len({WORDS.format('base')}) as nb from v),
f as (select task, instance_id, null::int as variant_idx, 'Q01' as check_id, 'warning' as severity from b where k <> {VARIANTS} union all select task, instance_id, null, 'Q07', 'warning' from b where conv_id % 5 = 1 or base = ''
 union all select task, instance_id, idx, 'Q02', 'warning' from w where sim < 0.82 union all select task, instance_id, idx, 'Q04', 'warning' from w where n < 5 or n > 3 * nb union all select task, instance_id, idx, 'Q05', 'warning' from w where para = base
 union all select task, instance_id, idx, 'Q06', 'warning' from w where not contains(prompt, para) or (para <> base and base <> '' and contains(prompt, base))
 union all select task, null, null, 'Q01', 'error' from b group by task having count(*) <> {INSTANCES})"""


@query(f"with {FOUND} select * from f")
def validation_findings(spark, sf_dir):
    """Every finding of the data set, prompts against paraphrase and base text, references as stored."""
    return validation.findings(nested(spark, sf_dir), INSTANCES, VARIANTS)


@query(f"""with {FOUND}, n as (select task, count(*) as instances from b group by task), s as (select task, count(*) as variants, avg(sim) as m from v group by task),
c as (select task, count(*) filter (severity = 'warning') as warnings, count(*) filter (severity = 'error') as errors from f group by task),
l as (select task, concat_ws(' ', check_id, instance_id, variant_idx) as line, row_number() over (partition by task order by instance_id nulls first, variant_idx nulls first, check_id) as nth from f where severity = 'warning'),
m as (select task, md5(string_agg(line, chr(10) order by nth)) as messages_md5 from l where nth <= 50 group by task)
select t.task, case when instances is null then 'missing_file' else 'checked' end as status, coalesce(instances, 0) as instances, coalesce(variants, 0) as variants, coalesce(warnings, 0) as warnings, case when instances is null then 1 else coalesce(errors, 0) end as errors,
 instances is not null and coalesce(errors, 0) = 0 as passed, round(s.m, 6) as mean_similarity, coalesce(messages_md5, md5('')) as messages_md5
 from (select unnest(['summarization', 'creative', 'dialogue', 'qa']) as task) t left join n using (task) left join s using (task) left join c using (task) left join m using (task)""")
def validation_report(spark, sf_dir):
    """The report of each data set asked for, with its first fifty warnings; a data set without a file has failed."""
    rows = nested(spark, sf_dir)
    tasks = spark.range(len(TASKS)).select(F.element_at(F.array(*[F.lit(t) for t in TASKS]), (F.col("id") + 1).cast("int")).alias("task"))
    out = validation.summary(rows, validation.findings(rows, INSTANCES, VARIANTS), tasks)
    return out.withColumn("mean_similarity", F.round("mean_similarity", 6)).withColumn("messages_md5", F.md5(F.array_join("messages", "\n"))).drop("messages")


@query(f"with {SCORED} select 'org/m' || model as model, 'org_m' || model as file, count(*) as in_folder, count(*) as in_table, count(*) as written, round(sum(sms), 4) as total from g group by model")
def model_files(spark, sf_dir):
    """A CSV folder for each model under its sanitised name and a combined table, read back; counts as the writer gave them."""
    rows = scored(spark, sf_dir).select(F.concat(F.lit("org/m"), F.col("model").cast("string")).alias("model"), "instance", "sms")
    by_model, combined = folder(spark, "models"), folder(spark, "combined")
    counts = results.write_models(rows, by_model, combined)
    written = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    files = spark.read.option("header", True).schema("model string, instance long, sms double, file string").csv(by_model).groupBy("model", "file").agg(F.count(F.lit(1)).alias("in_folder"), F.round(F.sum("sms"), 4).alias("total"))
    whole = spark.read.parquet(combined).groupBy("model").agg(F.count(F.lit(1)).alias("in_table"))
    return files.join(whole, "model").withColumn("written", written[F.col("model")].cast("long"))


@query("select doc_id, min(doc_id) over (partition by text, lang) as record from documents where text is not null and lang is not null")
def record_lookup(spark, sf_dir):
    """Every row finds the first record of its text and label, by a join on both in place of a scan for each; a text that very many share is no hot task."""
    d = staged(table(spark, sf_dir, "documents").where("text is not null and lang is not null").select("doc_id", F.sha2("text", 256).alias("digest"), "lang"))
    first = d.groupBy("digest", "lang").agg(F.min("doc_id").alias("record"))
    return lookup(d, first, ["digest", "lang"], "inner").select("doc_id", "record")
