"""Tests and correlations with their p-values, for many experiments at once.

An experiment is an event type with a cohort of users (two users, a few dozen, the rest), an item is a user. Events of even number are the baseline's
results, odd ones the treated run's; a repeated run of a user replaces the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordvane.functions import scores
from wordvane.operators import significance
from wordvane.plans.catalog import query
from wordvane.plans.measures import COMPOSED, composites, scored
from wordvane.session import table

#: Users below which cohorts end.
COHORTS = (2, 40)


def results(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(baseline, treated): a row for each experiment, user and run, of which there are up to three."""
    e = table(spark, sf_dir, "events")
    cohort = F.when(F.col("user_id") < COHORTS[0], "few").when(F.col("user_id") < COHORTS[1], "some").otherwise("rest")
    e = e.select(F.concat_ws("/", F.col("event_type"), cohort).alias("experiment"), F.col("user_id").alias("item"), (F.col("event_id") % 3).alias("run"), (F.col("event_id") % 2).alias("side"), (F.col("value") / 100).alias("x"), F.dayofmonth("ts").alias("day"))
    g = e.groupBy("experiment", "item", "run", "side").agg(scores.rounded(F.avg("x"), 1).alias("m"), F.coalesce(F.var_pop("x"), F.lit(0.0)).alias("v"), F.min("x").alias("least"), F.min("day").alias("layer"))
    base = g.where("side = 0").select("experiment", "item", "run", F.col("m").alias("rouge_mean"), F.col("v").alias("rouge_var"))
    after = g.where("side = 1").select("experiment", "item", "run", F.when(F.col("item") % 11 != 0, F.col("m")).alias("treated_mean"), F.when(F.col("item") % 22 != 0, scores.rounded(F.col("least"), 1)).alias("treated_single"), F.when(F.col("item") % 13 != 5, F.col("v")).alias("treated_var"), "layer")
    return base, after


#: Number of ways of each positive sum for up to 50 ranks; normal tail by Simpson's rule.
PAIRED = """g as (select event_type || '/' || case when user_id < 2 then 'few' when user_id < 40 then 'some' else 'rest' end as experiment, user_id as item, event_id % 3 as run, event_id % 2 as side, round(avg(value / 100), 1) as m, coalesce(var_pop(value / 100), 0.0) as v, round(min(value / 100), 1) as least, min(day(ts)) as layer from events group by all),
l as (select *, row_number() over (partition by experiment, item, side order by run desc) as nth from g),
p as (select b.experiment, b.item, b.m as rouge_mean, b.v as rouge_var, coalesce(case when a.item % 11 <> 0 then a.m end, case when a.item % 22 <> 0 then a.least end) as after, case when a.item % 13 <> 5 then a.v end as treated_var, a.layer from l b join l a on b.experiment = a.experiment and b.item = a.item and b.side = 0 and a.side = 1 and b.nth = 1 and a.nth = 1),
q as (select *, rouge_var - treated_var as d_var, rouge_mean - after as d_rouge from p where treated_var is not null and after is not null),
d as (select experiment, 'var' as kind, d_var as d from q union all select experiment, 'rouge', d_rouge from q),
r as (select *, rank() over (partition by experiment, kind order by abs(d)) + (count(*) over (partition by experiment, kind, abs(d)) - 1) / 2.0 as r, count(*) over (partition by experiment, kind, abs(d)) as t from d where d <> 0),
s as (select experiment, kind, count(*) as n, coalesce(sum(r) filter (d > 0), 0.0)::double as w, sum(t * t - 1)::double as tied from r group by all),
ways as (with recursive w(n, w) as (select 0, [1::hugeint] union all select n + 1, list_transform(range(0, len(w) + n + 1), lambda s: (case when s < len(w) then w[s + 1] else 0 end) + (case when s > n then w[s - n] else 0 end)) from w where n < 50) select * from w),
z as (select s.*, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tied / 48) as z from s where n >= 2),
t as (select z.*, 0.5 - abs(z) / 2000 / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), lambda i: case when i = 0 or i = 2000 then 1 when i % 2 = 1 then 4 else 2 end * exp(-0.5 * (abs(z) * i / 2000) ** 2))) as tail from z),
u as (select t.experiment, t.kind, t.n, t.w, case when t.n <= 50 and tied = 0 then list_sum(ways.w[ceil(t.w)::bigint + 1:])::double / 2.0 ** t.n end as up, case when t.n <= 50 and tied = 0 then list_sum(ways.w[1:floor(t.w)::bigint + 1])::double / 2.0 ** t.n end as down, tail, z from t left join ways on ways.n = t.n),
pv as (select experiment, kind, n, case when kind = 'var' then w else least(w, n * (n + 1) / 2.0 - w) end as statistic, case when kind = 'var' then coalesce(up, case when z >= 0 then tail else 1 - tail end) else least(1.0, 2 * coalesce(least(up, down), tail)) end as p_value from u)"""


def _tests(kind: str) -> str:
    return f"coalesce({kind}s.n, 0) as {kind}_n_used, round({kind}p.statistic, 4) as {kind}_statistic, round({kind}p.p_value, 6) as {kind}_p_value, coalesce({kind}p.p_value < 0.01, false) as {kind}_significant, case when coalesce({kind}s.n, 0) < 2 then '{significance.TOO_FEW}' end as {kind}_note"


@query(f"""with {PAIRED}, a as (select experiment, count(*) as n_items, avg(rouge_mean) as b, avg(after) as t, avg(rouge_var) as bv, avg(treated_var) as tv, case when count(*) >= 2 and stddev_samp(d_var) >= 1e-12 then avg(d_var) / stddev_samp(d_var) end as var_dz, case when count(*) >= 2 and stddev_samp(d_rouge) >= 1e-12 then -avg(d_rouge) / stddev_samp(d_rouge) end as rouge_dz,
 avg(layer) as lm, stddev_pop(layer) as ls, min(layer) as l0, max(layer) as l1 from q group by experiment)
select a.experiment, n_items, round(b, 6) as baseline_rouge, round(t, 6) as treated_rouge, round(t - b, 6) as rouge_change, round(case when b > 0 then (t - b) * 100 / b else 0.0 end, 6) as rouge_change_pct, round(bv, 6) as baseline_var, round(tv, 6) as treated_var, round(case when bv > 0 then 1 - tv / bv else 0.0 end, 6) as var_reduction, round(var_dz, 6) as var_dz, round(rouge_dz, 6) as rouge_dz,
 round(lm, 6) as layer_mean, round(ls, 6) as layer_std, l0 as layer_least, l1 as layer_most, round(ls / lm, 6) as layer_cv, tv = 0.0 as variance_eliminated, abs(t - b) < 2.0 as quality_preserved, {_tests('var')}, {_tests('rouge')}
 from a left join s vars on a.experiment = vars.experiment and vars.kind = 'var' left join pv varp on a.experiment = varp.experiment and varp.kind = 'var' left join s rouges on a.experiment = rouges.experiment and rouges.kind = 'rouge' left join pv rougep on a.experiment = rougep.experiment and rougep.kind = 'rouge'""")
def evaluation_summary(spark, sf_dir):
    """Both results aligned by key, last run first; signed-rank tests with p, significance or a note; effect sizes, changes, layers."""
    out = significance.evaluation(*results(spark, sf_dir), "experiment", "item", "run")
    r = lambda c, digits=6: F.round(c, digits).alias(c)
    rounded = ("baseline_rouge", "treated_rouge", "rouge_change", "rouge_change_pct", "baseline_var", "treated_var", "var_reduction", "var_dz", "rouge_dz", "layer_mean", "layer_std", "layer_cv")
    rest = [x for name in ("var", "rouge") for x in (F.col(f"{name}_n_used"), r(f"{name}_statistic", 4), r(f"{name}_p_value"), F.col(f"{name}_significant"), F.col(f"{name}_note"))]
    return out.select("experiment", "n_items", *[r(c) for c in rounded], "layer_least", "layer_most", "variance_eliminated", "quality_preserved", *rest)


@query()
def evaluation_intervals(spark, sf_dir):
    """For each experiment bootstrap intervals of the variance reduction and of the change of ROUGE-L, 10,000 resamples."""
    return significance.evaluation_intervals(*results(spark, sf_dir), "experiment", "item", "run")


METRICS = {"pri": "PRI", "d_pri": "Diagnostic_PRI", "sms": "SMS", "cs": "CS", "faithfulness": "Faithfulness", "trd": "TRD", "trd_semantic": "TRD_Semantic", "kpig_advanced": "KPIG_Advanced"}
ALWAYS = ("PRI", "SMS", "CS", "Faithfulness", "TRD")


def _simpson(start: str) -> str:
    """The integral of cos(x) ** (n - 3) from start to half of pi."""
    width = f"(pi() / 2 - {start})"
    return f"({width} * list_sum(list_transform(range(0, 10001), lambda i: case when i = 0 or i = 10000 then 1 when i % 2 = 1 then 4 else 2 end * exp((n - 3) * ln(greatest(cos({start} + {width} * i / 10000), 1e-300))))))"


@query(f"""with {COMPOSED}, n as (select case when instance = 1 then 'order 1/' else '' end || model as grp, floor(human * 10000) / 10000 as human, {', '.join(f"{c} as {m}" for c, m in METRICS.items() if c not in ('trd_semantic', 'kpig_advanced'))}, case when model % 2 = 0 then 0.0 else bf end as TRD_Semantic, case when model % 3 = 0 then kpig else 0.0 end as KPIG_Advanced from k),
u as (unpivot n on {', '.join(METRICS.values())} into name metric value x), c as (select grp, metric, count(*) as n, bool_or(x <> 0) as nonzero, stddev_pop(x) < 1e-10 or stddev_pop(human) < 1e-10 as flat from u group by all),
k2 as (select *, rank() over (partition by grp, metric order by x) + (count(*) over (partition by grp, metric, x) - 1) / 2.0 as rx, rank() over (partition by grp, metric order by human) + (count(*) over (partition by grp, metric, human) - 1) / 2.0 as rh from u),
r as (select grp, metric, any_value(c.n) as n, case when any_value(flat) then 0.0 else corr(x, human) end as pr, case when any_value(flat) then 0.0 else corr(rx, rh) end as sr from k2 join c using (grp, metric) where c.n >= 3 and (nonzero or metric in ({', '.join(repr(x) for x in ALWAYS)})) group by all),
p as (select *, list_transform([pr, sr], lambda v: case when v = 0 then 1.0 when abs(v) >= 1 then 0.0 else {_simpson('asin(abs(v))')} / {_simpson('0')} end) as ps from r)
select grp as model, metric, 'complete' as status, n, round(pr, 4) as pearson_r, round(ps[1], 6) as pearson_p, round(sr, 4) as spearman_rho, round(ps[2], 6) as spearman_p from p union all select grp, null, 'insufficient_data', max(n), null, null, null, null from c where n < 3 group by grp""")
def correlation_analysis(spark, sf_dir):
    """Composites and metrics with the human score, Pearson and Spearman with p; too small groups are reported, optional metrics only where they aren't 0 throughout."""
    g, c = composites(scored(spark, sf_dir)), F.col
    # Groups are numbers until the report: twice the model, and 1 more for order 1.
    wide = g.select((c("model") * 2 + F.when(c("instance") == 1, 1).otherwise(0)).alias("group"), (F.floor(F.col("human") * 10000) / 10000).alias("human"), *[c(k).alias(m) for k, m in METRICS.items() if k not in ("trd_semantic", "kpig_advanced")], F.when(c("model") % 2 == 0, 0.0).otherwise(c("bf")).alias("TRD_Semantic"), F.when(c("model") % 3 == 0, c("kpig")).otherwise(0.0).alias("KPIG_Advanced"))
    out = significance.wide_correlation_report(wide, "group", list(METRICS.values()), "human", ALWAYS)
    first = F.pmod("group", F.lit(2))
    name = F.concat(F.when(first == 1, "order 1/").otherwise(""), ((c("group") - first) / 2).cast("long").cast("string"))
    return out.select(name.alias("model"), "metric", "status", "n", *[F.round(x, d).alias(x) for x, d in (("pearson_r", 4), ("pearson_p", 6), ("spearman_rho", 4), ("spearman_p", 6))])
