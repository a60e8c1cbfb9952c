"""Tables of single tokens: a user is an instance, event types are its variants, an event is a token; its value stands for loss and entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordvane.operators import evaluation, key_points, layers
from wordvane.plans.catalog import query
from wordvane.plans.dialogue import EXCHANGES, TOKENS, exchanges, turns
from wordvane.plans.keypoints import DOT, responses
from wordvane.session import table
from wordvane.sources.stores import staged

N_LAYERS = 8
FIRST, AFTER = layers.scan_range(N_LAYERS)


def tokens(spark, sf_dir) -> DataFrame:
    place = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("inst"), F.col("event_type").alias("variant"), (F.row_number().over(place) - 1).alias("pos"), (F.col("value") / 100).alias("x"))


def log_probs(spark, sf_dir) -> DataFrame:
    """Every token at every layer; one variant of every seventh instance lacks layer 5, every thirteenth instance has one variant."""
    t = tokens(spark, sf_dir).where((F.col("inst") % 13 != 5) | (F.col("variant") == "click")).withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(N_LAYERS - 1))))
    t = t.where((F.col("inst") % 7 != 3) | (F.col("layer") != 5) | (F.col("variant") != "signup"))
    return t.select("inst", "variant", "layer", "pos", (-F.col("x") * (1 + ((F.col("layer") * 7 + F.col("pos") * 3 + F.length("variant")) % 11) / 20)).alias("lp"))


TABLES = f"""t as (select user_id as inst, event_type as variant, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as pos, value / 100 as x from events),
lp as (select inst, variant, layer, pos, -x * (1 + ((layer * 7 + pos * 3 + length(variant)) % 11) / 20.0::double) as lp from t, range(0, {N_LAYERS}) l(layer) where (inst % 13 <> 5 or variant = 'click') and (inst % 7 <> 3 or layer <> 5 or variant <> 'signup'))"""
CURVE = f"""{TABLES}, k as (select inst, count(distinct variant) as k from lp group by inst), m as (select inst, variant, layer, avg(exp(least(-lp, 20))) as m from lp where layer >= {FIRST} and layer < {AFTER} group by all),
c as (select inst, layer, var_samp(m) as s from m join k using (inst) group by inst, layer having count(*) = any_value(k) and any_value(k) > 1)"""


@query(f"with {CURVE} select inst, layer::int as layer, round(s, 6) as s from c")
def layer_sensitivity(spark, sf_dir):
    """Of each instance and layer of the scan range, the variance over variants of the mean token perplexity."""
    return layers.sensitivity_curve(log_probs(spark, sf_dir), N_LAYERS).withColumn("s", F.round("s", 6))


@query(f"""with {CURVE}, d as (select *, s - lag(s) over (partition by inst order by layer) as delta from c), z as (select inst, avg(s) + 2 * stddev_samp(s) as thr from c group by inst),
f as (select d.inst, coalesce(arg_max(layer, (delta, -layer)) filter (delta is not null), max(layer)) as inflection, coalesce(min(layer) filter (s > thr), arg_max(layer, (s, -layer))) as zscore from d left join z using (inst) group by d.inst)
select i.inst, coalesce(inflection, {AFTER - 1})::int as inflection, coalesce(zscore, {AFTER - 1})::int as zscore, 6 as forced from (select distinct inst from lp) i left join f using (inst)""")
def chosen_layer(spark, sf_dir):
    """The layer by inflection, by deviation and by decree."""
    lp = log_probs(spark, sf_dir)
    curve, instances = layers.sensitivity_curve(lp, N_LAYERS), lp.select("inst").distinct()
    forced = layers.chosen_layers(curve, instances, AFTER - 1, forced=6).select("inst", F.col("inflection").alias("forced"))
    return layers.chosen_layers(curve, instances, AFTER - 1).join(forced, "inst")


@query(f"""with {TABLES}, b as (select inst, variant, pos, exp(x / 2) as b from t), l as (select inst, variant, max(pos) + 1 as len, avg(b) as mean from b group by all), n as (select inst, min(len) as min_len, avg(mean) as mean_branching from l group by inst),
v as (select b.inst, pos, var_samp(b) as v from b join n on b.inst = n.inst and pos < min_len group by b.inst, pos), p as (select inst, avg(v) as pc_stab from v group by inst),
q as (select inst, variant, exp(least(avg(-lp), 20)) as ppl from lp where layer = {N_LAYERS - 1} group by all), r as (select inst, stddev_samp(ppl) as ppl_var, avg(ppl) as ppl_mean from q group by inst)
select inst, round(pc_stab, 6) as pc_stab, min_len::int as min_len, round(mean_branching, 6) as mean_branching, round(ppl_var, 6) as ppl_var, round(ppl_mean, 6) as ppl_mean from p join n using (inst) join r using (inst)""")
def position_stability(spark, sf_dir):
    """Branching varied over variants position by position, and the spread of whole sequences' perplexity."""
    h = tokens(spark, sf_dir).select("inst", "variant", "pos", (F.col("x") / 2).alias("h"))
    out = layers.branching_stability(h).join(layers.sequence_perplexity(log_probs(spark, sf_dir), N_LAYERS), "inst")
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("inst", r("pc_stab"), F.col("min_len").cast("int").alias("min_len"), r("mean_branching"), r("ppl_var"), r("ppl_mean"))


#: Tokens longer than this have no stored vector.
STORED = 8


@query(f"""with {EXCHANGES}, e as (select conv_id, pos, case when conv_id % 5 = 0 then ' ' else question end as reference, answer from x),
s as (select conv_id, pos, 'p' as side, {TOKENS.format('answer')} as toks from e union all select conv_id, pos, 'r', {TOKENS.format('reference')} from e),
c as (select conv_id, pos, side, u, count(*)::double as n from (select conv_id, pos, side, unnest(toks) as u from s) group by all),
uv0 as (select distinct u, '#' || u || '#' as p from c where length(u) <= {STORED}), uv1 as (select u, list_transform(range(1, length(p) - 1), lambda j: ('0x' || substr(md5(substr(p, j, 3)), 1, 4))::bigint % {key_points.DIMS}) as spots from uv0),
uv2 as (select u, list_transform(range(0, {key_points.DIMS}), lambda k: len(list_filter(spots, lambda y: y = k))::double) as c from uv1), uv as (select u, list_transform(c, lambda a: a / sqrt(list_sum(list_transform(c, lambda d: d * d)))) as v from uv2),
k as (select c.*, v from c join uv using (u)), g as (select a.conv_id, a.pos, a.u as pu, b.u as ru, {DOT.format('a.v', 'b.v')} as sim from k a join k b on a.conv_id = b.conv_id and a.pos = b.pos and a.side = 'p' and b.side = 'r'),
m as (select conv_id, pos, 'p' as side, pu as u, max(sim) as best from g group by all union all select conv_id, pos, 'r', ru, max(sim) from g group by all),
w as (select c.conv_id, c.pos, c.side, sum(c.n * coalesce(best, 0)) / sum(c.n) as f, count(k.u) > 0 as has from c left join m using (conv_id, pos, side, u) left join k using (conv_id, pos, side, u) group by all),
z as (select e.conv_id, e.pos, coalesce(a.f, 0.0) as p, coalesce(b.f, 0.0) as r, coalesce(a.has, true) and coalesce(b.has, true) as available from e left join w a on a.conv_id = e.conv_id and a.pos = e.pos and a.side = 'p' left join w b on b.conv_id = e.conv_id and b.pos = e.pos and b.side = 'r')
select conv_id || '/' || pos as pair, round(p, 4) as precision, round(r, 4) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 4) as f1, available from z""")
def token_vector_score(spark, sf_dir):
    """Precision, recall and F1 of greedy matching by stored token vectors."""
    e = exchanges(spark, sf_dir)
    pairs = staged(e.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("pos").cast("string")).alias("pair"), F.when(F.col("conv_id") % 5 == 0, " ").otherwise(F.col("question")).alias("reference"), F.col("answer").alias("response")))
    known = pairs.select(F.explode(F.concat(key_points.text.tokens(F.col("reference")), key_points.text.tokens(F.col("response")))).alias("unit")).where(F.length("unit") <= STORED)
    out = key_points.token_matching(pairs, staged(key_points.hashed_units(known)))
    return out.select("pair", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "available")


NUMBERS = "sms trd kpig auc_e ppl_var bf cs hs faithfulness human avg_length avg_coverage trd_length rouge1 rouge2 rougeL pri ori ifi diagnostic_ori diagnostic_ifi diagnostic_pri usd ipri confidence final final_dynamic".split()


def stored_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(responses, judged, entailed, internals) of conversations. A turn's number stands for what judge and entailment model said; every fourth conversation has no
    entailment outputs, and those whose number is no user's have no internals."""
    r = responses(spark, sf_dir)
    first = turns(spark, sf_dir).groupBy(F.col("conv_id").alias("instance")).agg(F.min_by("text", "turn").alias("input_text"))
    said = F.element_at(F.array(*[F.lit(x) for x in ("ENTAILMENT", "neutral", "contradiction", "?")]), (F.col("idx") % 4 + 1).cast("int"))
    judged = r.select("instance", "idx", F.concat(F.lit("Score: "), (F.col("idx") % 7).cast("string")).alias("raw"))
    entailed = r.where("instance % 4 <> 2").select("instance", "idx", said.alias("raw"))
    inside = position_stability(spark, sf_dir).select(F.col("inst").alias("instance"), F.least(F.lit(1.0), "ppl_var").alias("ppl_var"), F.least(F.lit(1.0), F.col("mean_branching") - 1).alias("bf"))
    return r.join(first, "instance"), judged, entailed, inside


@query()
def evaluate_stored_samples(spark, sf_dir):
    """All metrics of every conversation from stored vectors, outputs and internals (C01, C03 to C06, C08 to C23, A21), with labels, flags and remarks."""
    r, judged, entailed, inside = stored_inputs(spark, sf_dir)
    r = staged(r)
    of_response = staged(key_points.hashed_texts(r, ["instance", "idx"], "response"))
    of_reference = key_points.hashed_texts(r.where(F.col("reference").rlike(r"\S")).groupBy("instance").agg(F.max("reference").alias("t")), ["instance"], "t")
    out = evaluation.evaluated(r, of_response, of_reference, None, judged, entailed, staged(inside))
    return out.select("instance", "k", *[F.round(x, 6).alias(x) for x in NUMBERS], "n_missing_reference", "n_irrelevant", "unstable", "hallucinated", "diagnosis", "label", "attribution", "remarks")
