"""Coverage of a reference by stored vectors of its units, and correctness and consistency of responses by stored vectors of whole texts.

An instance is a conversation: its first turn is the reference (none for every fifth conversation), its later turns are the responses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordvane.functions import fixed, scores
from wordvane.operators import key_points
from wordvane.plans.catalog import query
from wordvane.plans.dialogue import TOKENS, WORDS, turns
from wordvane.plans.procedural import CONTENT
from wordvane.plans.tables import PROMPTS

DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"


def responses(spark, sf_dir) -> DataFrame:
    t = turns(spark, sf_dir)
    base = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.min("turn").alias("t0"))
    reference = F.when(F.col("conv_id") % 5 != 0, F.col("first"))
    return t.join(base, "conv_id").where("turn > t0").select(F.col("conv_id").alias("instance"), F.col("turn").alias("idx"), reference.alias("reference"), F.col("text").alias("response"))


RESPONSES = """b as (select conv_id, arg_min(text, turn) as first, min(turn) as t0 from conversations group by conv_id),
r as (select c.conv_id as inst, c.turn as idx, case when c.conv_id % 5 <> 0 then b.first end as reference, c.text as response from conversations c join b on c.conv_id = b.conv_id and c.turn > b.t0)"""

STOPS = ", ".join(repr(w) for w in fixed.STOP_WORDS)
#: Units of every text; unit vectors of letter triples; matches from the least cosine on.
UNITS = f"""{RESPONSES}, x as (select inst, idx, response as t from r union all select inst, -1, any_value(reference) from r where trim(reference) <> '' group by inst),
y as (select inst, idx, {TOKENS.format('t')} as toks, {CONTENT} as w, list_filter(list_transform(regexp_extract_all(' ' || coalesce(t, ''), '[^\\p{{L}}\\p{{N}}_]([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)', 1), lambda n: lower(n)), lambda n: length(n) >= 3 and n not in ({STOPS})) as named from x),
z as (select inst, idx, toks, list_distinct(named || w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) as units from y),
held as (select inst, idx, unnest(units) as u from z where idx >= 0),
wanted as (select inst, unnest(units) as u from z where idx = -1 union all select distinct inst, u from held where inst not in (select inst from z where idx = -1)),
uv0 as (select u, '#' || u || '#' as p from (select u from held union select u from wanted)),
uv1 as (select u, list_transform(range(1, length(p) - 1), lambda j: ('0x' || substr(md5(substr(p, j, 3)), 1, 4))::bigint % {key_points.DIMS}) as spots from uv0),
uv2 as (select u, list_transform(range(0, {key_points.DIMS}), lambda k: len(list_filter(spots, lambda y: y = k))::double) as c from uv1),
uv as (select u, list_transform(c, lambda a: a / greatest(sqrt(list_sum(list_transform(c, lambda d: d * d))), 1e-8)) as v from uv2),
sims as (select w.inst, w.u as ref, h.u as unit, round({DOT.format('a.v', 'b.v')}, 9) as sim from wanted w join (select distinct inst, u from held) h using (inst) join uv a on a.u = w.u join uv b on b.u = h.u),
near as (select * from sims where sim >= {key_points.LEAST_COSINE}),
best as (select h.inst, h.idx, ref, max(sim) as sim, arg_max(unit, (sim, -nth)) as unit from held h join (select *, dense_rank() over (order by unit) as nth from near) n on h.inst = n.inst and h.u = n.unit group by all)"""


@query(f"with {UNITS} select inst as instance, idx, ref, unit, round(sim, 6) as sim from best")
def unit_matches(spark, sf_dir):
    """Of each response the unit most similar to each unit of the reference, from a cosine of 0.55 on."""
    texts, wanted = key_points.unit_tables(responses(spark, sf_dir))
    held = texts.where("idx >= 0").select("instance", "idx", F.explode("units").alias("unit"))
    return key_points.best_matches(wanted, held, key_points.hashed_matrix).withColumn("sim", F.round("sim", 6))


@query(f"""with {UNITS}, n as (select inst, count(*)::double as n from x group by inst),
tf as (select inst, idx, u, count(*)::double as tf from (select inst, idx, unnest(toks) as u from z) semi join wanted using (inst, u) group by all),
df as (select inst, u, count(*)::double as df from tf group by all), w as (select inst, idx, u, tf * (ln((1 + n) / (1 + df)) + 1) as x, n from tf join df using (inst, u) join n using (inst)),
l as (select inst, idx, sqrt(sum(x * x)) as len from w group by all), imp as (select inst, u, sum(x / len) / any_value(n) as imp from w join l using (inst, idx) group by all),
met as (select inst, ref as u, count(*) as freq, avg(sim) as avg_sim from best group by all),
u0 as (select inst, u, greatest(coalesce(imp, 0.0), {key_points.LEAST_IMPORTANCE}) as imp, coalesce(freq, 0) as freq, coalesce(avg_sim, 0.0) as avg_sim from wanted left join imp using (inst, u) left join met using (inst, u)),
u1 as (select *, imp / max(imp) over (partition by inst) * (0.3 + 0.7 / (1 + freq)) as w from u0),
base as (select inst, sum(w * avg_sim) / (sum(w) + 1e-8) as base, count(*) as n_units, count(*) filter (freq > 0) as n_matched from u1 group by inst),
hits as (select inst, idx, count(*) as hits from best group by all),
each as (select x.inst, coalesce(base, 0.0) as base, coalesce(n_units, 0) as n_units, coalesce(n_matched, 0) as n_matched, coalesce(coalesce(hits, 0)::double / n_units, 0.0) as c from x left join base using (inst) left join hits on x.inst = hits.inst and x.idx = hits.idx where x.idx >= 0)
select inst as instance, round(greatest(0.0, least(1.0, any_value(base) * case when count(*) < 2 then 1.0 else greatest(0.3, 1 - exp(-3 * stddev_pop(c))) end)), 6) as kpig, round(any_value(base), 6) as base, round(avg(c), 6) as coverage, any_value(n_units) as n_units, any_value(n_matched) as n_matched from each group by inst""")
def kpig_by_vectors(spark, sf_dir):
    """Key-point coverage by similar units; where the reference is blank, of the union of the responses' units."""
    out = key_points.coverage_scores(responses(spark, sf_dir))
    return out.select("instance", *[F.round(c, 6).alias(c) for c in ("kpig", "base", "coverage")], "n_units", "n_matched")


#: Of text t: counts of its tokens by place, scaled to length 1.
TEXT_VECTOR = f"""tv0 as (select id, list_transform({TOKENS.format('t')}, lambda w: ('0x' || substr(md5(w), 1, 4))::bigint % {key_points.DIMS}) as spots from tx),
tv1 as (select id, spot, count(*)::double as n from (select id, unnest(spots) as spot from tv0) group by all),
tv2 as (select tx.id, list(coalesce(n, 0.0) order by k) as c from tx cross join range(0, {key_points.DIMS}) g(k) left join tv1 on tv1.id = tx.id and tv1.spot = k group by tx.id),
tv as (select id, list_transform(c, lambda a: a / greatest(sqrt(list_sum(list_transform(c, lambda d: d * d))), 1e-8)) as v from tv2)"""
_PROMPTS = ", ".join("'" + p.replace("'", "''") + "'" for p in PROMPTS)


def prompted(spark, sf_dir) -> DataFrame:
    """Responses with a prompt of the constant list each; every third conversation has one that asks for nothing."""
    listed = F.element_at(F.array(*[F.lit(p) for p in PROMPTS]), (F.col("idx") % len(PROMPTS) + 1).cast("int"))
    return responses(spark, sf_dir).withColumn("prompt", F.when(F.col("instance") % 3 == 0, "Tell me more.").otherwise(listed))


@query(f"""with {RESPONSES}, tx as (select (inst, idx) as id, response as t from r), {TEXT_VECTOR},
pairs as (select a.id[1] as inst, avg({DOT.format('a.v', 'b.v')}) as cos from tv a join tv b on a.id[1] = b.id[1] and a.id[2] < b.id[2] group by all),
p as (select inst, response, case when inst % 3 = 0 then 'tell me more.' else lower(([{_PROMPTS}])[idx % {len(PROMPTS)} + 1]) end as p from r),
q as (select *, nullif(regexp_extract(p, '(?:in|under|maximum|max|limit to)\\s+([0-9]+)\\s+words?', 1), '')::double as lim, case when regexp_matches(p, '\\b(short|brief|concise)\\b') then 'short' when regexp_matches(p, '\\b(detailed|long|comprehensive)\\b') then 'long' end as len_, regexp_matches(p, '\\b(bullet points|bullets|list)\\b') as fmt, len({WORDS.format('response')})::double as n from p),
s as (select inst, response, list_filter([case when lim is null then null when n <= lim * 1.1 then 1.0 when lim = 0 then 0.0 else greatest(0.0, 1 - (n - lim) / lim) end, case when len_ = 'short' then case when n < 100 then 1.0 else 0.5 end when len_ = 'long' then case when n >= 50 then 1.0 else 0.5 end end, case when fmt then case when regexp_matches(response, '(^|\\n)(\\s*[-*•]\\s|\\s*[0-9]+\\.\\s)') then 1.0 else 0.0 end end], lambda x: x is not null) as parts from q),
c as (select inst, avg(case when len(parts) > 0 then list_sum(parts)::double / len(parts) end) as compliance, bool_or(regexp_matches(coalesce(response, ''), '\\S')) as filled, count(*) as k from s group by inst)
select c.inst as instance, round(case when not filled then 0.0 when compliance is null then sem else least(1.0, 0.7 * sem + 0.3 * compliance) end, 6) as kpig_legacy, round(sem, 6) as semantic, round(compliance, 6) as compliance
 from (select c.*, case when k < 2 then 1.0 else greatest(0.0, coalesce(cos, 0.0)) end as sem from c left join pairs using (inst)) c""")
def kpig_constrained(spark, sf_dir):
    """Mean pairwise cosine of an instance's responses, from the length of their sum, with the mean compliance of those whose prompt asks for something."""
    out = key_points.constrained_consistency(prompted(spark, sf_dir))
    return out.select("instance", *[F.round(c, 6).alias(c) for c in ("kpig_legacy", "semantic", "compliance")])


ENTITIES = "list_distinct(list_filter(regexp_extract_all(coalesce({0}, ''), '([\\p{{L}}\\p{{N}}_]+)', 1), lambda w: regexp_matches(w, '^[A-Z][A-Za-z0-9]+$')))"


@query(f"""with {RESPONSES}, tx as (select (inst, idx) as id, response as t from r union all select (inst, -1), any_value(reference) from r where regexp_matches(coalesce(reference, ''), '\\S') group by inst), {TEXT_VECTOR},
e as (select r.inst, r.idx, regexp_matches(coalesce(reference, ''), '\\S') as there, greatest(0.0, coalesce({DOT.format('a.v', 'b.v')} / nullif(sqrt({DOT.format('a.v', 'a.v')}) * sqrt({DOT.format('b.v', 'b.v')}), 0), 0.0)) as cosine, {ENTITIES.format('reference')} as er, {ENTITIES.format('response')} as ea, len({WORDS.format('response')})::double as n, len({WORDS.format('reference')})::double as nr
 from r left join tv a on a.id[1] = r.inst and a.id[2] = r.idx left join tv b on b.id[1] = r.inst and b.id[2] = -1),
f as (select inst, idx, there, case when there then cosine else 0.0 end as cosine, case when not there then 0.0 when n = 0 then 0.0 when n / nr < 0.5 then n / nr / 0.5 when n / nr <= 2 then 1.0 else greatest(0.0, 1 - (n / nr - 2) / 2) end as adequacy, case when not there then 0.0 when len(er) = 0 then 1.0 else len(list_intersect(er, ea))::double / len(er) end as entity_coverage, case when there then n else 0.0 end as n from e),
g as (select *, least(1.0, 0.4 * cosine + 0.2 * adequacy + 0.4 * entity_coverage) * case when entity_coverage < 0.2 then 0.6 else 1.0 end as cs from f)
select inst as instance, round(avg(cs), 6) as cs, round(avg(n), 6) as avg_length, round(avg(entity_coverage), 6) as avg_coverage, round(avg(cosine), 6) as avg_cosine, count(*) filter (not there) as missing_reference, count(*) filter (there and cs < 0.25) as irrelevant from g group by inst""")
def correctness_scores(spark, sf_dir):
    """Cosine with the reference, length adequacy and entity coverage of each response, their means over the instance, and flags."""
    r = responses(spark, sf_dir)
    out = key_points.correctness(r, key_points.hashed_texts(r, ["instance", "idx"], "response"), key_points.hashed_texts(r.where(F.col("reference").rlike(r"\S")).groupBy("instance").agg(F.max("reference").alias("t")), ["instance"], "t"))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    flagged = lambda f: F.count(F.when(F.col("flag") == f, 1)).alias(f)
    return out.groupBy("instance").agg(mean("cs", "cs"), mean("n_words", "avg_length"), mean("entity_coverage", "avg_coverage"), mean("cosine", "avg_cosine"), flagged("missing_reference"), flagged("irrelevant"))
