"""Composite scores, statistics and layer analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordvane.functions import fixed, scores, text, vectors
from wordvane.operators import stats
from wordvane.plans.catalog import query
from wordvane.plans.dialogue import WORDS
from wordvane.plans.tables import average_rank, centroids, embedded
from wordvane.session import table


# Scored samples: one row per (model, instance), from order lines; model is the supplier's number modulo 10, instance the order.
def scored(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    d = lambda c: F.col(c).cast("double")
    r = lambda x: scores.rounded(x, 6)
    g = l.groupBy((F.col("l_suppkey") % 10).alias("model"), F.col("l_orderkey").alias("instance")).agg(
        r(1 - F.avg(d("l_discount")) * 3).alias("sms"), r(F.avg(d("l_quantity")) / 50).alias("cs"), r(1 - F.avg(d("l_tax")) * 4).alias("faithfulness"), r(F.avg(d("l_discount")) * 5).alias("trd"),
        r(F.max(d("l_quantity")) / 50).alias("auc_e"), r(F.min(d("l_quantity")) / 50 + 0.3).alias("kpig"), r(F.avg(d("l_tax")) * 5).alias("ppl_var"), r(F.avg(d("l_discount")) * 2).alias("bf"),
        r(F.avg(d("l_extendedprice")) / 60000).alias("human"), F.max(d("l_quantity")).alias("avg_length"),
    )
    return g


SCORED = """g as (select l_suppkey % 10 as model, l_orderkey as instance, round(1 - avg(l_discount::double) * 3, 6) as sms, round(avg(l_quantity::double) / 50, 6) as cs, round(1 - avg(l_tax::double) * 4, 6) as faithfulness, round(avg(l_discount::double) * 5, 6) as trd,
 round(max(l_quantity::double) / 50, 6) as auc_e, round(min(l_quantity::double) / 50 + 0.3, 6) as kpig, round(avg(l_tax::double) * 5, 6) as ppl_var, round(avg(l_discount::double) * 2, 6) as bf, round(avg(l_extendedprice::double) / 60000, 6) as human, max(l_quantity::double) as avg_length from lineitem group by 1, 2)"""


def composites(g: DataFrame, weights=fixed.PRI_WEIGHTS) -> DataFrame:
    """C12 to C23 as columns of scored samples: every composite, from one row."""
    c = F.col
    g = g.withColumns({
        "pri": scores.pri(c("sms"), c("cs"), c("faithfulness"), c("avg_length"), weights), "ori": scores.ori(c("sms"), c("auc_e"), c("trd"), c("kpig")), "ifi": scores.ifi(c("ppl_var"), c("bf")),
        "d_ori": scores.diagnostic_ori(c("sms"), c("auc_e"), c("trd"), c("kpig")), "d_ifi": scores.diagnostic_ifi(c("ppl_var"), c("bf")),
    })
    g = g.withColumns({"d_pri": scores.diagnostic_pri(c("d_ori"), c("d_ifi")), "final": scores.final_static(c("pri"), c("human")), "usd": scores.usd(c("pri"), c("human")), "ipri": scores.ipri(c("pri"), c("cs")), "confidence": scores.confidence(c("sms"), c("cs"), c("faithfulness"))})
    g = g.withColumns({"final_dynamic": scores.final_dynamic(c("pri"), c("human"), c("usd")), "diagnosis": scores.diagnosis(c("d_ori"), c("d_ifi")), "reliability": scores.reliability(c("pri"))})
    return g.withColumn("attribution", scores.attribution([c("sms"), c("auc_e"), c("kpig")], [c("trd"), c("ppl_var"), c("bf")]))


def _c(x: str) -> str:
    return f"least(1.0, greatest(0.0, {x}))"


COMPOSED = f"""{SCORED},
h as (select *, {_c(f"(0.40 * {_c('sms')} + 0.35 * {_c('cs')} + 0.25 * {_c('faithfulness')}) * case when avg_length < 12 then 0.85 else 1.0 end")} as pri, {_c('(sms + auc_e + (1 - trd) + kpig) / 4')} as ori, {_c('1 - (ppl_var + bf) / 2')} as ifi,
 {_c('sms')} as s1, {_c('auc_e')} as s2, {_c('kpig')} as s3, {_c(f"1 - {_c('trd')}")} as s4, {_c(f"1 - {_c('ppl_var')}")} as i1, {_c(f"1 - {_c('bf')}")} as i2 from g),
i as (select *, case when s1 <= 0 or s2 <= 0 or s3 <= 0 or s4 <= 0 then 0.0 else {_c('1.0 / (0.4 / s1 + 0.3 / s2 + 0.2 / s3 + 0.1 / s4)')} end as d_ori, case when i1 <= 0 or i2 <= 0 then 0.0 else {_c('0.8 / (0.5 / i1 + 0.3 / i2)')} end as d_ifi, abs(pri - human) as usd from h),
j as (select *, case when d_ori <= 0 or d_ifi <= 0 then 0.0 else {_c('1.0 / (0.5 / d_ori + 0.5 / d_ifi)')} end as d_pri, {_c('0.6 * pri + 0.4 * human')} as final, {_c('(1 - least(0.7, 0.4 + 0.3 * usd)) * pri + least(0.7, 0.4 + 0.3 * usd) * human')} as final_dynamic, {_c('pri * cs')} as ipri, (sms + cs + faithfulness) / 3 as confidence,
 case when d_ori >= 0.7 and d_ifi >= 0.7 then 'Robust' when d_ori >= 0.7 then 'Externally Stable / Internally Fragile' when d_ifi >= 0.7 then 'Internally Stable / Output-Sensitive' else 'Fragile' end as diagnosis,
 case when pri >= 0.7 then 'Robust' when pri >= 0.5 then 'Moderate' else 'Unreliable' end as reliability,
 least(s1, s2, s3, {_c('1 - trd')}, {_c('1 - ppl_var')}, {_c('1 - bf')}) as lo, greatest(s1, s2, s3, {_c('1 - trd')}, {_c('1 - ppl_var')}, {_c('1 - bf')}) as hi, (s1 + s2 + s3 + {_c('1 - trd')} + {_c('1 - ppl_var')} + {_c('1 - bf')}) / 6 as mean from i),
k as (select *, case when lo >= 0.65 then 'True Robustness' when lo < 0.2 then 'Evaluation Artifact' when mean >= 0.55 and hi - lo > 0.35 then 'Stochastic Luck' else 'Knowledge Boundary' end as attribution from j)"""
MEANS = ("pri", "ori", "ifi", "d_ori", "d_ifi", "d_pri", "final", "final_dynamic", "usd", "ipri", "confidence", "sms", "cs", "faithfulness", "trd")


@query(f"""with {COMPOSED}, m as (select model, count(*) as n, {', '.join(f'round(avg({x}), 6) as {x}' for x in MEANS)} from k group by model)
select *, cast(floor(rank() over (order by final desc) + (count(*) over (partition by final) - 1) / 2.0) as integer) as rank from m""")
def leaderboard(spark, sf_dir):
    """The flagship, C12 to C21, C29, A01, A02, W01, L01: composites of every scored sample, means per model, average ranks."""
    m = composites(scored(spark, sf_dir)).groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(x), 6).alias(x) for x in MEANS])
    return m.withColumn("rank", F.floor(average_rank("final")).cast("int"))


@query(f"with {COMPOSED} select model, count(*) filter (diagnosis = 'Robust') as robust, count(*) filter (diagnosis = 'Externally Stable / Internally Fragile') as externally_stable, count(*) filter (diagnosis = 'Internally Stable / Output-Sensitive') as internally_stable, count(*) filter (diagnosis = 'Fragile') as fragile from k group by model")
def diagnosis_crosstab(spark, sf_dir):
    """Models by diagnosis, zeros filled."""
    labels = {"Robust": "robust", "Externally Stable / Internally Fragile": "externally_stable", "Internally Stable / Output-Sensitive": "internally_stable", "Fragile": "fragile"}
    wide = composites(scored(spark, sf_dir)).groupBy("model").pivot("diagnosis", list(labels)).count().na.fill(0)
    return wide.select("model", *[F.col(f"`{k}`").alias(v) for k, v in labels.items()])


@query(f"with {COMPOSED} select attribution, reliability, count(*) as n from k group by all")
def attribution_counts(spark, sf_dir):
    """Robustness types by reliability label."""
    return composites(scored(spark, sf_dir)).groupBy("attribution", "reliability").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {COMPOSED}, r as (select model, instance, d_pri, row_number() over (partition by model order by d_pri desc, instance) as k from k) select model, instance, round(d_pri, 6) as d_pri from r where k <= 5")
def top_samples(spark, sf_dir):
    """The five best samples of each model (a top-k report)."""
    g = composites(scored(spark, sf_dir))
    best = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("d_pri"), "instance"))
    return g.withColumn("k", best).where("k <= 5").select("model", "instance", F.round("d_pri", 6).alias("d_pri"))


@query(f"with {SCORED}, m as (select *, ppl_var / greatest(0.001, max(ppl_var) over (partition by model)) as p, bf / greatest(0.001, max(bf) over (partition by model)) as b from g) select model, instance, round(p, 6) as ppl_var_norm, round(b, 6) as bf_norm, round({_c('1 - (p + b) / 2')} + 1e-9, 4) as ifi_norm from m")
def ifi_normalised(spark, sf_dir):
    """Scaling by each model's maximum, which is aggregated first and joined back, so that no model's rows meet in one task."""
    g = scored(spark, sf_dir)
    most = g.groupBy("model").agg(F.greatest(F.lit(0.001), F.max("ppl_var")).alias("mp"), F.greatest(F.lit(0.001), F.max("bf")).alias("mb"))
    p, b = F.col("ppl_var") / F.col("mp"), F.col("bf") / F.col("mb")
    return g.join(most, "model").select("model", "instance", F.round(p, 6).alias("ppl_var_norm"), F.round(b, 6).alias("bf_norm"), F.round(scores.clamp01(1 - (p + b) / 2) + 1e-9, 4).alias("ifi_norm"))


@query(f"""with {SCORED}, f as (select *, greatest(sms, 1e-6) as a, greatest(cs, 1e-6) as b, greatest(faithfulness, 1e-6) as c from g)
select model, round(avg(4.0 / (2 / a + 1 / b + 1 / c)), 6) as harmonic, round(avg(exp((2 * ln(a) + ln(b) + ln(c)) / 4)), 6) as geometric, round(avg((2 * sms + cs + faithfulness) / 4), 6) as arithmetic,
 round(avg((case when sms > 1e-9 then 1 else 0 end + case when cs > 1e-9 then 1 else 0 end + case when faithfulness > 1e-9 then 1 else 0 end) / nullif(case when sms > 1e-9 then 1 / sms else 0 end + case when cs > 1e-9 then 1 / cs else 0 end + case when faithfulness > 1e-9 then 1 / faithfulness else 0 end, 0)), 3) as skipping from f group by model""")
def score_aggregators(spark, sf_dir):
    """The three means with a floor, and the harmonic one that skips zeros."""
    v, w = [F.col("sms"), F.col("cs"), F.col("faithfulness")], (2.0, 1.0, 1.0)
    agg = [F.round(F.avg(scores.aggregate_scores(v, w, m)), 6).alias(m) for m in ("harmonic", "geometric", "arithmetic")]
    return scored(spark, sf_dir).groupBy("model").agg(*agg, F.round(F.avg(scores.harmonic_skipping(F.array(*v))), 3).alias("skipping"))


def _harmonic2(x: str, y: str) -> str:
    return f"case when {x} > 1e-9 and {y} > 1e-9 then round(2 / (1 / {x} + 1 / {y}), 4) when {x} > 1e-9 then {x} else {y} end"


@query(f"""with {SCORED}, p as (select *, case when bf > 0 then 1 - ppl_var / bf else 0.0 end as red from g),
s as (select model, instance, round(1 / (1 + ppl_var), 4) as a, round(least(1.0, greatest(0.0, 1 - trd)), 4) as b, round(exp(-0.5 * ppl_var), 4) as c, round(exp(-0.5 * bf), 4) as d, red from p),
h as (select *, {_harmonic2('a', 'b')} as ori, {_harmonic2('c', 'd')} as ifi from s), i as (select *, {_harmonic2('ori', 'ifi')} as pri from h)
select model, round(avg(ori), 4) as mean_ori, round(avg(ifi), 4) as mean_ifi, round(avg(pri), 4) as mean_pri, round(avg(red), 6) as mean_reduction,
 case when avg(ori) >= 0.7 and avg(ifi) >= 0.7 then 'True Robustness' when avg(ori) >= 0.7 then 'Evaluation Artifact' when avg(ifi) >= 0.7 then 'Stochastic Luck' else 'Knowledge Boundary' end as diagnosis from i group by model""")
def light_composites(spark, sf_dir):
    """C26, M03, M07, M08, light diagnosis: external, internal and whole scores as harmonic means that skip absent parts."""
    c, r = F.col, lambda x: F.round(x, 4)
    g = scored(spark, sf_dir).select("model", r(1 / (1 + c("ppl_var"))).alias("a"), r(scores.clamp01(1 - c("trd"))).alias("b"), r(F.exp(-0.5 * c("ppl_var"))).alias("c"), r(F.exp(-0.5 * c("bf"))).alias("d"), scores.safe_reduction(c("ppl_var"), c("bf")).alias("red"))
    g = g.withColumn("ori", scores.harmonic_skipping(F.array("a", "b"))).withColumn("ifi", scores.harmonic_skipping(F.array("c", "d"))).withColumn("pri", scores.harmonic_skipping(F.array("ori", "ifi")))
    mean = lambda k: r(F.avg(k)).alias(f"mean_{k}")
    return g.groupBy("model").agg(mean("ori"), mean("ifi"), mean("pri"), F.round(F.avg("red"), 6).alias("mean_reduction"), scores.diagnosis_light(F.avg("ori"), F.avg("ifi")).alias("diagnosis"))


@query(f"""with {SCORED}, c as (select c.g, s.model, avg(abs(s.pri0 - c.g)) as v from (select model, 0.4 * sms + 0.6 * cs as pri0 from g) s, (select unnest([0.25, 0.5, 0.75]) as g) c group by all), r as (select model, g::double as g, row_number() over (partition by model order by v, g) as k from c) select model, g as chosen from r where k = 1""")
def grid_selection(spark, sf_dir):
    """A grid of three settings against every sample; the best by objective, the first of equals."""
    s = scored(spark, sf_dir).select("model", (0.4 * F.col("sms") + 0.6 * F.col("cs")).alias("p"), F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("g"))
    v = s.groupBy("model", "g").agg(F.avg(F.abs(F.col("p") - F.col("g"))).alias("v"))
    return v.groupBy("model").agg(F.min_by("g", F.struct("v", "g")).alias("chosen"))


DOCS = f"""d as (select l.quality::double as human, len({WORDS.format('d.text')})::double as words, d.n_chars::double as chars, length(regexp_replace(d.text, '[^\\x00-\\x7F]', '', 'g'))::double / greatest(length(d.text), 1) as ascii from documents d join labels l using (doc_id)),
u as (select unnest(['words', 'chars', 'ascii']) as metric, unnest([words, chars, ascii]) as x, human from d)"""


@query(f"""with {DOCS}, r as (select *, rank() over (partition by metric order by x) + (count(*) over (partition by metric, x) - 1) / 2.0 as rx, rank() over (partition by metric order by human) + (count(*) over (partition by metric, human) - 1) / 2.0 as rh from u)
select metric, count(*) as n, round(corr(x, human), 4) as pearson_r, round(corr(rx, rh), 4) as spearman_rho from r group by metric""")
def metric_correlation(spark, sf_dir):
    """Pearson and Spearman of document metrics with the human label; ranks come from counts of distinct values."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    wide = d.select(F.col("quality").cast("double").alias("human"), text.word_count(F.col("text")).cast("double").alias("words"), F.col("n_chars").cast("double").alias("chars"), text.ascii_ratio(F.col("text")).alias("ascii"))
    found = stats.wide_correlations(wide.withColumn("all", F.lit(0)), "all", ["words", "chars", "ascii"], "human").where("n is not null")
    return found.select("metric", "n", F.round("pearson", 4).alias("pearson_r"), F.round("spearman", 4).alias("spearman_rho"))


PAIRED = """e as (select user_id, avg(value) filter (event_id % 2 = 0) as a, avg(value) filter (event_id % 2 = 1) as b from events group by user_id),
d as (select user_id, a, b, a - b as d from e where a is not null and b is not null),
r as (select *, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as r from d where d <> 0)"""


@query(f"""with {PAIRED} select (select count(*) from d) as n_pairs, count(*) as n_used, round(sum(r) filter (d > 0), 4) as w_plus, round(least(sum(r) filter (d > 0), sum(r) filter (d < 0)), 4) as w_min, (select round(avg(d) / stddev_samp(d), 6) from d) as dz, (select round(1 - avg(b) / avg(a), 6) from d) as reduction from r""")
def paired_tests(spark, sf_dir):
    """Signed-rank statistics, effect size and relative change of paired means; tests with p are in evaluation_summary."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b"))
    # Equal differences are equal whatever the order of their sums: digits that the larger mean doesn't have don't count.
    place = F.pow(F.lit(10.0), 12 - F.ceil(F.log10(F.greatest(F.abs("a"), F.abs("b")))))
    d = e.where("a is not null and b is not null").withColumn("d", F.when(F.col("a") == F.col("b"), 0.0).otherwise(scores.settled(F.round((F.col("a") - F.col("b")) * place) / place)))
    w = stats.signed_rank(d, "d")
    rest = d.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("d") / F.nullif(F.stddev_samp("d"), F.lit(0.0)), 6).alias("dz"), F.round(scores.safe_reduction(F.avg("b"), F.avg("a")), 6).alias("reduction"))
    return rest.crossJoin(F.broadcast(w)).select("n_pairs", "n_used", F.round("w_plus", 4).alias("w_plus"), F.round("w_min", 4).alias("w_min"), "dz", "reduction")  # one row each


# Layers: instance is a user, variant an event type, layer the day of the month, perplexity the value.
LAYERS = """v as (select user_id as inst, event_type as variant, day(ts)::int as layer, avg(value) as ppl from events group by all),
s as (select inst, layer, var_samp(ppl) as s from v group by all), q as (select * from s where s is not null),
d as (select *, s - lag(s) over (partition by inst order by layer) as delta from q)"""


def layer_curve(spark, sf_dir) -> DataFrame:
    """Inst, layer, s: sample variance over variants of each layer's mean perplexity."""
    v = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("inst"), F.col("event_type").alias("variant"), F.dayofmonth("ts").alias("layer")).agg(F.avg("value").alias("ppl"))
    return v.groupBy("inst", "layer").agg(F.var_samp("ppl").alias("s")).where("s is not null")


@query(f"""with {LAYERS}, z as (select inst, avg(s) + 2 * stddev_samp(s) as thr from q group by inst), f as (select q.inst, min(q.layer) as layer from q join z using (inst) where q.s > z.thr group by q.inst),
m as (select inst, arg_max(layer, (delta, -layer)) filter (delta is not null) as inflection, max(layer) as last, arg_max(layer, (s, -layer)) as peak from d group by inst)
select m.inst, coalesce(m.inflection, m.last)::int as ell_inflection, coalesce(f.layer, m.peak)::int as ell_zscore from m left join f using (inst)""")
def sensitivity_layer(spark, sf_dir):
    """The layer of the greatest first difference, and the first above mean + 2 deviations, else the peak."""
    s = layer_curve(spark, sf_dir)
    s = s.withColumn("delta", F.col("s") - F.lag("s").over(Window.partitionBy("inst").orderBy("layer")))
    z = s.groupBy("inst").agg((F.avg("s") + 2 * F.stddev_samp("s")).alias("thr"))
    first = s.join(z, "inst").where("s > thr").groupBy("inst").agg(F.min("layer").alias("first"))
    m = s.groupBy("inst").agg(F.max_by("layer", F.when(F.col("delta").isNotNull(), F.struct("delta", -F.col("layer")))).alias("inflection"), F.max("layer").alias("last"), F.max_by("layer", F.struct("s", -F.col("layer"))).alias("peak"))
    return m.join(first, "inst", "left").select("inst", F.coalesce("inflection", "last").alias("ell_inflection"), F.coalesce("first", "peak").alias("ell_zscore"))


@query(f"""with {LAYERS}, m as (select inst, coalesce(arg_max(layer, (delta, -layer)) filter (delta is not null), max(layer))::double as ell from d group by inst) select count(*) as n, round(avg(ell), 6) as mean, round(stddev_pop(ell), 6) as std, min(ell) as least, max(ell) as most, round(stddev_pop(ell) / avg(ell), 6) as cv from m""")
def layer_distribution(spark, sf_dir):
    """How the chosen layers are spread."""
    ell = sensitivity_layer(spark, sf_dir).select(F.col("ell_inflection").cast("double").alias("ell"))
    return ell.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ell"), 6).alias("mean"), F.round(F.stddev_pop("ell"), 6).alias("std"), F.min("ell").alias("least"), F.max("ell").alias("most"), F.round(F.try_divide(F.stddev_pop("ell"), F.avg("ell")), 6).alias("cv"))


# Words that stand at positions of the layer table: stop words, punctuation and content.
SHOWN = ("the", "price", "of", "market", "!!", "share", "and")
STOPS = ", ".join(f"'{w}'" for w in fixed.ANCHOR_STOP_WORDS)
TOKENS_OF = f"""t as (select user_id as inst, event_type as variant, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as pos, case when isfinite(value) then value end as ppl, ([{', '.join(f"'{w}'" for w in SHOWN)}])[event_id % 7 + 1] as tok from events),
n as (select inst, min(k) as n from (select inst, variant, count(*) as k from t group by all) group by inst),
a as (select t.inst, t.pos, avg(ppl) as m, var_samp(ppl) as v, min(n.n) as n, bool_or(ppl is null) as bad, arg_min(tok, variant) as tok from t join n on t.inst = n.inst and t.pos < n.n group by all),
k as (select *, row_number() over (partition by inst order by case when bad then 1.797e308 else m end, pos) + row_number() over (partition by inst order by case when bad or v is null then 1.797e308 else v end, pos) - 2 as stab, lower(trim(tok)) not in ({STOPS}) and not regexp_matches(tok, '^[[:punct:]]+$') as content from a),
r as (select *, row_number() over (partition by inst order by bad, not content, stab, pos) as nth, greatest(1, least(round_even(n * 30 / 100.0, 0)::bigint, n // 2)) as target from k)"""


def aligned_positions(spark, sf_dir) -> DataFrame:
    """inst, pos, m, v, n, bad, content of the positions that all variants of an instance have: mean and variance over variants, to 12 digits, so that
    equal ones are equal whatever the order of their sums; non-finite values masked."""
    place = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    word = F.element_at(F.array(*[F.lit(w) for w in SHOWN]), (F.col("event_id") % len(SHOWN) + 1).cast("int"))
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("inst"), F.col("event_type").alias("variant"), (F.row_number().over(place) - 1).cast("long").alias("pos"), F.when(finite, F.col("value")).alias("ppl"), word.alias("tok"))
    n = t.groupBy("inst", "variant").agg(F.count(F.lit(1)).alias("k")).groupBy("inst").agg(F.min("k").alias("n"))
    a = t.join(n, "inst").where("pos < n").groupBy("inst", "pos").agg(scores.settled(F.avg("ppl")).alias("m"), scores.settled(F.var_samp("ppl")).alias("v"), F.min("n").alias("n"), F.bool_or(F.col("ppl").isNull()).alias("bad"), F.min_by("tok", "variant").alias("tok"))
    return a.withColumn("content", ~F.lower(F.trim("tok")).isin(*fixed.ANCHOR_STOP_WORDS) & ~F.col("tok").rlike(r"^\p{Punct}+$"))


@query(f"with {TOKENS_OF} select inst, pos, stab, target from r where nth <= target")
def anchors(spark, sf_dir):
    """The most stable 30 % of aligned positions, content words first, masked ones last."""
    a, worst = aligned_positions(spark, sf_dir), F.lit(1.797e308)
    by = lambda c: F.row_number().over(Window.partitionBy("inst").orderBy(c, "pos"))
    a = a.withColumn("stab", (by(F.when(F.col("bad"), worst).otherwise(F.col("m"))) + by(F.when(F.col("bad") | F.col("v").isNull(), worst).otherwise(F.col("v"))) - 2).cast("long"))
    nth = F.row_number().over(Window.partitionBy("inst").orderBy("bad", ~F.col("content"), "stab", "pos"))
    target = F.greatest(F.lit(1), F.least(F.bround(F.col("n") * 30 / 100.0, 0).cast("long"), F.floor(F.col("n") / 2)))
    return a.withColumn("nth", nth).withColumn("target", target.cast("long")).where("nth <= target").select("inst", "pos", "stab", "target")


@query(f"with {TOKENS_OF} select inst, pos, round(m, 6) as mean, round(v, 6) as variance from a where m < 50 and v < 900")
def threshold_anchors(spark, sf_dir):
    """Positions whose mean and variance over variants lie under thresholds."""
    return aligned_positions(spark, sf_dir).where("m < 50 and v < 900").select("inst", "pos", F.round("m", 6).alias("mean"), F.round("v", 6).alias("variance"))


# Re-aggregation of stored scores: every seventh instance lacks its consistency, every eleventh its faithfulness.
CUSTOM_WEIGHTS = (0.5, 0.3, 0.1)
STORED = f"""{SCORED}, q as (select model, instance, case when instance % 7 = 0 then null else sms end as sms, cs, case when instance % 11 = 0 then null else faithfulness end as faithfulness, avg_length, human from g)"""


def stored_scores(spark, sf_dir) -> DataFrame:
    g, c = scored(spark, sf_dir), F.col
    return g.select("model", "instance", F.when(c("instance") % 7 != 0, c("sms")).alias("sms"), "cs", F.when(c("instance") % 11 != 0, c("faithfulness")).alias("faithfulness"), "avg_length", "human")


@query(f"""with {STORED}, p as (select *, {_c(f"(0.5 * {_c('coalesce(sms, 0)')} + 0.3 * {_c('coalesce(cs, 0)')} + 0.1 * {_c('coalesce(faithfulness, 0)')}) * case when avg_length < 12 then 0.85 else 1.0 end")} as pri from q)
select model, count(*) as n_samples, round(sum(coalesce(sms, 0)) / count(*), 4) as sms, round(sum(coalesce(cs, 0)) / count(*), 4) as cs, round(sum(coalesce(faithfulness, 0)) / count(*), 4) as faithfulness, round(avg(pri), 4) as pri, round(avg({_c('0.6 * pri + 0.4 * human')}), 4) as final, abs(0.5 + 0.3 + 0.1 - 1) > 1e-6 as weights_warning from p group by model""")
def reaggregated(spark, sf_dir):
    """Composites of stored scores recomputed with custom weights; a missing metric counts as 0, and weights that don't sum to 1 are flagged."""
    zero = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    q = stored_scores(spark, sf_dir).select("model", "avg_length", "human", *[zero(k).alias(k) for k in ("sms", "cs", "faithfulness")])
    q = q.withColumn("pri", scores.pri(F.col("sms"), F.col("cs"), F.col("faithfulness"), F.col("avg_length"), CUSTOM_WEIGHTS))
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return q.groupBy("model").agg(F.count(F.lit(1)).alias("n_samples"), *[mean(k, k) for k in ("sms", "cs", "faithfulness", "pri")], mean(scores.final_static(F.col("pri"), F.col("human")), "final")).withColumn("weights_warning", F.lit(abs(sum(CUSTOM_WEIGHTS) - 1) > 1e-6))


CARDS = ("sms", "cs", "faithfulness", "trd", "auc_e", "kpig", "ppl_var", "human")


@query(f"with {SCORED} select count(distinct model) as n_models, " + ", ".join(f"round(avg({k}), 4) as {k}" for k in CARDS) + " from g where model in (1, 3, 5)")
def card_means(spark, sf_dir):
    """Eight means over the selected models."""
    g = scored(spark, sf_dir).where(F.col("model").isin(1, 3, 5))
    return g.agg(F.count_distinct("model").alias("n_models"), *[F.round(F.avg(k), 4).alias(k) for k in CARDS])


@query("""with r as (select o_orderpriority as topic, l_orderkey, avg(l_discount::double) as m from lineitem join orders on o_orderkey = l_orderkey group by all),
v as (select cast(l_linenumber as varchar) as variant, avg(l_discount::double) as m, count(*) as n from lineitem group by 1)
select 'topic' as kind, topic as name, count(*) as n, round(avg(m), 6) as mean from r group by topic union all select 'variant', variant, n, round(m, 6) from v""")
def topic_and_variant_means(spark, sf_dir):
    """Means of row means by topic, and means by variant over rows. An order is a row, its lines are its variants."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("x"))  # noqa: E741
    rows = l.groupBy("l_orderkey").agg(F.avg("x").alias("m")).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("name")), "l_orderkey")
    topics = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m"), 6).alias("mean")).select(F.lit("topic").alias("kind"), "name", "n", "mean")
    variants = l.groupBy(F.col("l_linenumber").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean")).select(F.lit("variant").alias("kind"), "name", "n", "mean")
    return topics.unionByName(variants)


@query(f"""with {STORED}, h as (select *, coalesce(sms, 1e-6) as a, coalesce(cs, 1e-6) as b, coalesce(faithfulness, 1e-6) as c from q)
select model, instance, round(case when a <= 0 or b <= 0 or c <= 0 then 0.0 else 3 / (1 / a + 1 / b + 1 / c) end, 6) as pri from h""")
def legacy_pri(spark, sf_dir):
    """Harmonic mean of three metrics; a missing one counts as 1e-6, one of zero gives 0."""
    a, b, c = (F.coalesce(F.col(k), F.lit(1e-6)) for k in ("sms", "cs", "faithfulness"))
    pri = F.when((a <= 0) | (b <= 0) | (c <= 0), 0.0).otherwise(F.try_divide(F.lit(3.0), F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b) + F.try_divide(F.lit(1.0), c)))
    return stored_scores(spark, sf_dir).select("model", "instance", F.round(pri, 6).alias("pri"))


@query("""with t as (select user_id as inst, event_type as variant, value / 100 as loss from events), p as (select inst, variant, exp(least(avg(loss), 20)) as ppl, avg(exp(least(loss, 20))) as h from t group by all)
select inst, round(stddev_samp(ppl), 6) as ppl_var, round(least(1.0, greatest(0.0, 2 * stddev_samp(ppl) / avg(ppl))), 6) as ppl_cv, round(least(1.0, greatest(0.0, avg(log2(1 + h)) / 8)), 6) as branching, round(var_samp(h), 6) as pc_stab from p group by inst""")
def internal_fidelity(spark, sf_dir):
    """Perplexity spread and branching from stored losses."""
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("inst"), F.col("event_type").alias("variant"), (F.col("value") / 100).alias("loss"))
    p = p.groupBy("inst", "variant").agg(F.exp(F.least(F.avg("loss"), F.lit(20.0))).alias("ppl"), F.avg(F.exp(F.least(F.col("loss"), F.lit(20.0)))).alias("h"))
    return p.groupBy("inst").agg(F.round(F.stddev_samp("ppl"), 6).alias("ppl_var"), F.round(scores.clamp01(2 * F.try_divide(F.stddev_samp("ppl"), F.avg("ppl"))), 6).alias("ppl_cv"), F.round(scores.clamp01(F.avg(F.log2(1 + F.col("h"))) / 8), 6).alias("branching"), F.round(F.var_samp("h"), 6).alias("pc_stab"))


@query("""with p as (select label, i, avg(embedding[i]::double) as m from (select label, embedding, unnest(range(1, 65)) as i from embeddings) group by all), c as (select label, list(m order by i) as c from p group by label),
b as (select e.vec_id, e.label, list_transform(list_zip(c.c, e.embedding), lambda z: 0.7 * z[1] + 0.3 * z[2]::double) as v from embeddings e join c using (label))
select vec_id, label, round(list_sum(list_transform(v, lambda x: x * x)), 6) as norm2 from b""")
def consensus_blend(spark, sf_dir):
    """Every vector drawn toward its group's mean."""
    e = embedded(spark, sf_dir)
    b = e.join(centroids(e, "label"), "label").withColumn("b", vectors.blend(F.col("centroid"), F.col("v"), 0.7))
    return b.select("vec_id", "label", F.round(vectors.dot(F.col("b"), F.col("b")), 6).alias("norm2"))


@query(f"""with {SCORED}, a as (select model, avg(auc_e) as m, stddev_samp(auc_e) as s, count(*) as n, min(auc_e) as one from g group by model) select model, round(case when n < 2 then one when m < 1e-9 then 0.0 else least(1.0, greatest(0.0, 1 - s / m)) end, 4) as auc_e from a""")
def auc_e(spark, sf_dir):
    """C30, C05 from given scores: 1 less the coefficient of variation."""
    a = scored(spark, sf_dir).groupBy("model").agg(F.avg("auc_e").alias("m"), F.stddev_samp("auc_e").alias("s"), F.count(F.lit(1)).alias("n"), F.min("auc_e").alias("one"))
    return a.select("model", F.round(F.when(F.col("n") < 2, F.col("one")).when(F.col("m") < 1e-9, 0.0).otherwise(scores.clamp01(1 - F.try_divide(F.col("s"), F.col("m")))), 4).alias("auc_e"))


@query(f"with {SCORED}, c as (select model, corr(sms, human) as r, count(*) as n from g group by model) select model, round(case when n < 2 or r is null or isnan(r) then 0.0 else least(1.0, greatest(-1.0, r)) end, 4) as agreement from c")
def human_agreement(spark, sf_dir):
    """Correlation with the human score, guarded against constant columns."""
    g = scored(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.when((F.stddev_pop("sms") > 1e-10) & (F.stddev_pop("human") > 1e-10), F.covar_pop("sms", "human") / (F.nullif(F.stddev_pop("sms") * F.stddev_pop("human"), F.lit(0.0)))).alias("r"))
    return g.select("model", F.round(F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r"))), F.lit(0.0))), 4).alias("agreement"))
