"""Pools, settings and answers that are chosen among candidates, and rows that are zipped with padding."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordvane.functions import fixed
from wordvane.operators import acceptance
from wordvane.plans.catalog import query
from wordvane.plans.dialogue import TOKENS, WORDS, turns
from wordvane.plans.inference import results
from wordvane.plans.measures import SCORED, scored
from wordvane.session import table

CANONICAL = "Write a short and neutral summary of the article in two or three sentences."
PER_LEVEL = 20
_LOW, _HIGH = fixed.POOL_SIMILARITY


@query(f"""with c as (select doc_id % 3 + 1 as level, doc_id // 3 % 4 as attempt, doc_id as id, text, (doc_id * 37 % 101) / 101.0::double * 0.3 + 0.72 as similarity from documents where text is not null),
t as (select *, list_distinct({TOKENS.format('text')}) as w, list_distinct({TOKENS.format(f"'{CANONICAL}'")}) as canon, array_to_string({WORDS.format('lower(text)')}[1:8], ' ') as sig from c),
r as (select * from t where len({WORDS.format('text')}) >= {fixed.POOL_WORDS} and similarity between {_LOW} and {_HIGH} and case when len(w) = 0 then 0 else len(list_intersect(w, canon))::double / len(list_distinct(w || canon)) end <= {fixed.POOL_OVERLAP} and sig <> array_to_string({WORDS.format(f"lower('{CANONICAL}')")}[1:8], ' ')),
f as (select *, row_number() over (partition by sig order by level, attempt, id) as k from r), n as (select *, row_number() over (partition by level order by attempt, id) as nth from f where k = 1)
select level, nth::int as nth, id, round(similarity, 6) as similarity from n where nth <= {PER_LEVEL}""")
def instruction_pool_filter(spark, sf_dir):
    """Documents stand for candidates of three levels in four attempts; signatures are shared by all levels, each takes its first twenty."""
    c = table(spark, sf_dir, "documents").where("text is not null").select((F.col("doc_id") % 3 + 1).alias("level"), (F.floor(F.col("doc_id") / 3) % 4).alias("attempt"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), "text", ((F.col("doc_id") * 37 % 101) / F.lit(101.0) * 0.3 + 0.72).alias("similarity"))
    return acceptance.pool_filter(c, CANONICAL, PER_LEVEL).withColumn("similarity", F.round("similarity", 6))


TAUS, ALPHAS, DEV = (0.1, 0.5), (0.3, 0.7), 200
FIXED = (0.9, 0.9)


@query(f"""with {SCORED}, d as (select *, row_number() over (partition by model order by instance) as nth from g), v as (select model, t.tau, a.alpha, t.i * {len(ALPHAS)} + a.i as ord, case when instance % 4 <> t.i and model <> 7 then sms * t.tau + cs * a.alpha end as score, case when instance % 5 <> a.i then abs(sms - a.alpha) * t.tau end as var
 from d, (select unnest([{', '.join(map(str, TAUS))}])::double as tau, unnest(range(0, {len(TAUS)})) as i) t, (select unnest([{', '.join(map(str, ALPHAS))}])::double as alpha, unnest(range(0, {len(ALPHAS)})) as i) a where nth <= {DEV}),
o as (select model, tau, alpha, ord, avg(score) - coalesce(avg(var), 0.0) as objective from v group by all having count(score) > 0), r as (select *, row_number() over (partition by model order by objective desc, ord) as k from o)
select m.model, coalesce(r.tau, {FIXED[0]}::double) as tau, coalesce(r.alpha, {FIXED[1]}::double) as alpha, round(objective, 6) as objective from (select distinct model from g) m left join r on m.model = r.model and k = 1""")
def tuned_setting(spark, sf_dir):
    """Over the dev prefix of each model the setting of greatest mean score less mean variance, the first of equals; failed runs don't count, and a model
    without any score keeps the fixed setting."""
    g, c = scored(spark, sf_dir), F.col
    grid = F.array(*[F.struct(F.lit(t).alias("tau"), F.lit(a).alias("alpha"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(i * len(ALPHAS) + j).alias("ord")) for i, t in enumerate(TAUS) for j, a in enumerate(ALPHAS)])
    dev = g.withColumn("nth", F.row_number().over(Window.partitionBy("model").orderBy("instance"))).where(c("nth") <= DEV).withColumn("s", F.explode(grid)).select("model", "instance", "sms", "cs", "s.*")
    runs = dev.select("model", "tau", "alpha", "ord", F.when((c("instance") % 4 != c("i")) & (c("model") != 7), c("sms") * c("tau") + c("cs") * c("alpha")).alias("score"), F.when(c("instance") % 5 != c("j"), F.abs(c("sms") - c("alpha")) * c("tau")).alias("var"))
    o = runs.groupBy("model", "tau", "alpha", "ord").agg(F.avg("score").alias("score"), F.coalesce(F.avg("var"), F.lit(0.0)).alias("var")).where("score is not null").withColumn("objective", c("score") - c("var"))
    best = o.groupBy("model").agg(F.max_by(F.struct("tau", "alpha", "objective"), F.struct("objective", -c("ord"))).alias("b"))
    return g.select("model").distinct().join(best, "model", "left").select("model", F.coalesce("b.tau", F.lit(FIXED[0])).alias("tau"), F.coalesce("b.alpha", F.lit(FIXED[1])).alias("alpha"), F.round("b.objective", 6).alias("objective"))


@query("""with t as (select conv_id, turn, text, lower(trim(left(text, 12))) as norm from conversations where text is not null), c as (select conv_id, norm, count(*) as votes, min(turn) as first from t group by all),
r as (select *, row_number() over (partition by conv_id order by votes desc, first) as k from c) select r.conv_id, md5(t.text) as surface_md5, votes, r.first as turn from r join t on r.conv_id = t.conv_id and t.turn = r.first where k = 1""")
def modal_answer(spark, sf_dir):
    """A10, X11: the most common answer of each conversation, compared by its trimmed, lower-cased beginning; the first met of equals, in the form in which it was met first."""
    t = turns(spark, sf_dir).where("text is not null").withColumn("norm", F.lower(F.trim(F.left("text", F.lit(12)))))
    c = t.groupBy("conv_id", "norm").agg(F.count(F.lit(1)).alias("votes"), F.min("turn").alias("turn"), F.min_by("text", "turn").alias("surface"))
    best = c.groupBy("conv_id").agg(F.max_by(F.struct(F.md5("surface").alias("surface_md5"), "votes", "turn"), F.struct("votes", -F.col("turn"))).alias("b"))
    return best.select("conv_id", "b.*")


@query()
def central_response(spark, sf_dir):
    """The response of each conversation that is nearest to its others by mean ROUGE-L."""
    t = turns(spark, sf_dir).select(F.col("conv_id").alias("instance"), F.col("turn").alias("idx"), F.coalesce("text", F.lit("")).alias("text"))
    return acceptance.centroid_response(t).withColumn("mean", F.round("mean", 6))


@query("""with t as (select conv_id, role, text, turn, row_number() over (partition by conv_id, role order by turn) - 1 as pos from conversations), s as (select conv_id, pos from t where role = 'user' and pos < 2), j as (select conv_id, pos, turn from t where role = 'assistant' and pos < 1)
select p.conv_id, p.pos as variant_idx, md5(p.text) as prompt_md5, md5(r.text) as response_md5, case when s.pos is not null then 'strategy' || s.pos end as strategy, case when j.pos is null then '' else 'Score ' || j.turn end as judge_raw_output
 from t p join t r on p.conv_id = r.conv_id and p.pos = r.pos and p.role = 'user' and r.role = 'assistant' left join s on s.conv_id = p.conv_id and s.pos = p.pos left join j on j.conv_id = p.conv_id and j.pos = p.pos""")
def response_rows(spark, sf_dir):
    """Prompts and responses zipped by position as far as both go; strategies that are fewer are padded with null, judges' outputs with an empty text."""
    t = turns(spark, sf_dir).withColumn("pos", (F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) - 1).cast("long"))
    of = lambda role: t.where(F.col("role") == role)
    strategies = of("user").where("pos < 2").select("conv_id", "pos", F.concat(F.lit("strategy"), F.col("pos").cast("string")).alias("strategy"))
    judged = of("assistant").where("pos < 1").select("conv_id", "pos", F.concat(F.lit("Score "), F.col("turn").cast("string")).alias("judge_raw_output"))
    rows = of("user").select("conv_id", "pos", F.md5("text").alias("prompt_md5")).join(of("assistant").select("conv_id", "pos", F.md5("text").alias("response_md5")), ["conv_id", "pos"])
    return rows.join(strategies, ["conv_id", "pos"], "left").join(judged, ["conv_id", "pos"], "left").withColumn("judge_raw_output", F.coalesce("judge_raw_output", F.lit(""))).withColumnRenamed("pos", "variant_idx")


@query("""with g as (select event_type || '/' || case when user_id < 2 then 'few' when user_id < 40 then 'some' else 'rest' end as experiment, user_id as item, event_id % 3 as run, event_id % 2 as side, round(avg(value / 100), 1) as m, coalesce(var_pop(value / 100), 0.0) as v, min(day(ts)) as layer from events group by all),
a as (select experiment, count(*) as n_rows, round(avg(v), 6) as mean_rouge_var, round(avg(m), 6) as mean_rouge_mean from g where side = 0 group by experiment),
t as (select experiment, count(*) filter (item % 13 <> 5) as succeeded, count(*) filter (item % 13 = 5) as failed, round(avg(case when item % 13 <> 5 then v end), 6) as mean_treated_var, count(distinct layer) as n_layers from g where side = 1 group by experiment)
select a.experiment, n_rows, mean_rouge_var, mean_rouge_mean, coalesce(succeeded, 0) as succeeded, coalesce(failed, 0) as failed, mean_treated_var, coalesce(n_layers, 0) as n_layers from a left join t using (experiment)""")
def experiment_summaries(spark, sf_dir):
    """Means of the items' variances and means, successes and failures, the means of what succeeded, and how many layers were chosen."""
    base, after = results(spark, sf_dir)
    a = base.groupBy("experiment").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("rouge_var"), 6).alias("mean_rouge_var"), F.round(F.avg("rouge_mean"), 6).alias("mean_rouge_mean"))
    t = after.groupBy("experiment").agg(F.count("treated_var").alias("succeeded"), F.count_if(F.col("treated_var").isNull()).alias("failed"), F.round(F.avg("treated_var"), 6).alias("mean_treated_var"), F.count_distinct("layer").alias("n_layers"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(t, "experiment", "left").select("experiment", "n_rows", "mean_rouge_var", "mean_rouge_mean", zero("succeeded"), zero("failed"), "mean_treated_var", zero("n_layers"))
