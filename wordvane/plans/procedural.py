"""Stemmed overlap, sequential acceptance, seeded perturbation, bootstrap, whole evaluations: what SQL can't express, or at length only."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordvane.functions import fixed, overlap, scores, text
from wordvane.operators import acceptance, coverage, perturb, stats
from wordvane.plans.catalog import query
from wordvane.plans.dialogue import EXCHANGES, TOKENS, WORDS, exchanges, pairs_within, turns
from wordvane.session import table


@query()
def rouge_bundle(spark, sf_dir):
    """All overlap metrics of each question-answer pair."""
    return exchanges(spark, sf_dir).select("conv_id", "pos", overlap.eval_metrics(F.col("answer"), F.col("question")).alias("m")).select("conv_id", "pos", "m.*")


@query()
def word_levenshtein_diversity(spark, sf_dir):
    """Mean word edit distance of an instance's pairs, and whether it is diverse enough."""
    t = turns(spark, sf_dir)
    d = pairs_within(t, "conv_id", "turn", "text").select("conv_id", overlap.word_levenshtein(F.col("text_i"), F.col("text_j")).alias("d"))
    return d.groupBy("conv_id").agg(F.round(F.avg("d"), 6).alias("mean_distance"), (F.avg("d") >= 10).alias("diverse"))


@query()
def consistency_light(spark, sf_dir):
    """Mean pairwise ROUGE-L of an instance's responses (its later turns), and the score of it and their mean ROUGE-L and BLEU against the reference (its first turn)."""
    t = turns(spark, sf_dir)
    base = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("reference"), F.min("turn").alias("t0"))
    r = t.join(base, "conv_id").where("turn > t0")
    own = r.select("conv_id", overlap.eval_metrics(F.col("text"), F.col("reference")).alias("m")).groupBy("conv_id").agg(F.avg("m.rougeL").alias("rl"), F.avg("m.bleu").alias("bleu"))
    pairs = pairs_within(r, "conv_id", "turn", "text").select("conv_id", overlap.rouge_l_score(F.col("text_i"), F.col("text_j")).alias("rl")).groupBy("conv_id").agg(F.avg("rl").alias("cs"))
    g = own.join(pairs, "conv_id", "left").withColumn("cs", F.coalesce("cs", F.lit(1.0)))  # a single response agrees with itself
    return g.select("conv_id", F.round("cs", 4).alias("cs"), F.round(0.40 * F.col("rl") + 0.35 * F.col("bleu") + 0.25 * F.col("cs"), 4).alias("hs"))


@query()
def rouge_auc_e(spark, sf_dir):
    """Spread of ROUGE-L of a group's later turns against its first."""
    t = turns(spark, sf_dir)
    base = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("reference"), F.min("turn").alias("t0"))
    s = t.join(base, "conv_id").where("turn > t0").select("conv_id", overlap.rouge_l_score(F.col("text"), F.col("reference")).alias("s"))
    g = s.groupBy("conv_id").agg(F.avg("s").alias("m"), F.stddev_samp("s").alias("sd"), F.var_pop("s").alias("v"), F.count(F.lit(1)).alias("n"))
    auc = F.when(F.col("n") < 2, F.col("m")).when(F.col("m") < 1e-9, 0.0).otherwise(scores.clamp01(1 - F.try_divide(F.col("sd"), F.col("m"))))
    return g.select("conv_id", F.round(auc, 6).alias("auc_e"), F.round("m", 6).alias("rouge_mean"), F.round("v", 6).alias("rouge_var"))


@query()
def greedy_accept(spark, sf_dir):
    """The accepted variants of each instance, in order."""
    t = turns(spark, sf_dir)
    base = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("base"), F.min("turn").alias("t0"))
    c = t.join(base, "conv_id").where("turn > t0").select(F.col("conv_id").alias("instance"), F.col("turn").alias("attempt"), F.col("role").alias("strategy"), "base", "text")
    return acceptance.greedy_accept(c)


def _drawn(items: str, least: int = 0) -> str:
    """Items in drawn order, in SQL."""
    return f"list_sort(list_transform(list_zip(range(0, len({items})), {items}), lambda z: {{'u': case when length(z[2]) >= {least} then ('0x' || substr(md5(h || '#' || seed || '#' || z[1]), 1, 8))::bigint / 4294967295.0::double else 2.0::double end, 'i': z[1], 'x': z[2]}}))"


#: Of a word w and a number u, the swap of two inner letters.
_AT = "least(length(w) - 2, floor(u * (length(w) - 3))::integer + 2)"
_SWAP = f"case when length(w) >= 4 then substr(w, 1, {_AT} - 1) || substr(w, {_AT} + 1, 1) || substr(w, {_AT}, 1) || substr(w, {_AT} + 2) else w end"


@query(f"""with r as (select item_id, coalesce(text, '') as t, md5(coalesce(text, '')) as h, unnest([0, 1, 3]) as seed from benchmark),
a as (select *, {WORDS.format('t')} as ws, list_filter(list_transform(string_split_regex(regexp_replace(trim(t), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|;\\s+'), lambda x: trim(x)), lambda x: x <> '') as ss, list_filter(list_transform(string_split(t, ', '), lambda x: trim(x)), lambda x: x <> '') as cs from r),
b as (select *, case when len(ss) > 1 then ss else cs end as ps from a),
typo0 as (select item_id, t, h, seed, ws, list_transform(({_drawn('ws', 4)})[1:greatest(1, round(len(ws) * 0.08)::integer)], lambda s: s.i) as hit from b where seed = 0),
typo1 as (select item_id, t, seed, hit, unnest(ws) as w, unnest(range(0, len(ws))) as i, h from typo0),
typo2 as (select *, ('0x' || substr(md5(h || '#' || seed || '#at' || i), 1, 8))::bigint / 4294967295.0::double as u from typo1),
typo as (select item_id, t, seed, string_agg(case when list_contains(hit, i) then {_SWAP} else w end, ' ' order by i) as v from typo2 group by item_id, t, seed),
re0 as (select item_id, t, seed, len(ps) as n, array_to_string(list_transform({_drawn('ps')}, lambda s: s.x), '. ') as j from b where seed = 1),
re as (select item_id, t, seed, case when n < 2 then t when regexp_matches(j, '[.!?]$') then j else j || '.' end as v from re0),
he as (select item_id, t, seed, ([{', '.join(repr(x) for x in fixed.HEDGES)}])[least({len(fixed.HEDGES)}, floor(('0x' || substr(md5(h || '#' || seed || '#hedge'), 1, 8))::bigint / 4294967295.0::double * {len(fixed.HEDGES)})::integer + 1)] || ' ' || lower(substr(t, 1, 1)) || substr(t, 2) as v from b where seed = 3)
select item_id, 'adv:' || (['typo', 'sentence_reorder', '', 'hedged'])[seed + 1] as strategy, seed::bigint as seed, md5(v) as variant_md5 from (select * from typo union all select * from re union all select * from he) where trim(v) <> '' and trim(v) <> trim(t)""")
def perturbed_by_hash(spark, sf_dir):
    """the strategies that draw: typos, reordered sentences, hedges."""
    v = perturb.variants(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text")
    return v.where(F.col("seed").isin(0, 1, 3)).select("item_id", "strategy", F.col("seed").cast("long").alias("seed"), F.md5("paraphrased_text").alias("variant_md5"))


@query()
def perturbed(spark, sf_dir):
    """Adversarial variants of the benchmark's texts, five strategies in turn."""
    v = perturb.variants(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text")
    return v.select("item_id", "strategy", F.col("seed").cast("long").alias("seed"), F.md5("paraphrased_text").alias("variant_md5"), F.col("strategy").startswith("adv:").alias("adversarial"))


@query()
def bootstrap_ci(spark, sf_dir):
    """Interval of the mean event value by Poisson bootstrap over all rows, 10,000 resamples."""
    return stats.poisson_bootstrap(table(spark, sf_dir, "events").where("value is not null"), "value", resamples=10_000)


CONTENT = f"list_filter({TOKENS.format('t')}, lambda w: regexp_matches(w, '^[a-z]+$') and length(w) >= 3 and w not in ({', '.join(repr(w) for w in fixed.STOP_WORDS)}))"


@query(f"""with b as (select conv_id, arg_min(text, turn) as reference, min(turn) as t0 from conversations group by conv_id),
x as (select c.conv_id as inst, c.turn as idx, c.text as t from conversations c join b on c.conv_id = b.conv_id and c.turn > b.t0 union all select conv_id, -1, reference from b where exists (select 1 from conversations c where c.conv_id = b.conv_id and c.turn > b.t0)),
y as (select inst, idx, {CONTENT} as w, list_filter(list_transform(regexp_extract_all(' ' || coalesce(t, ''), '[^\\p{{L}}\\p{{N}}_]([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)', 1), lambda n: lower(n)), lambda n: length(n) >= 3 and n not in ({', '.join(repr(w) for w in fixed.STOP_WORDS)})) as named from x),
z as (select inst, idx, w, list_distinct(named || w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) as units from y),
tf as (select inst, idx, u, count(*)::double as tf from (select inst, idx, unnest(w) as u from z) group by all),
n as (select inst, count(*)::double as n from x group by inst), df as (select inst, u, count(*)::double as df from tf group by all),
w as (select tf.inst, tf.idx, tf.u, tf * (ln((1 + n) / (1 + df)) + 1) as x, n from tf join df using (inst, u) join n using (inst)),
l as (select inst, idx, sqrt(sum(x * x)) as len from w group by all), imp as (select inst, u, sum(x / len) / any_value(n) as imp from w join l using (inst, idx) group by all),
held as (select inst, idx, unnest(units) as u from z where idx >= 0), freq as (select inst, u, count(distinct idx) as freq from held group by all),
u0 as (select a.inst, a.u, greatest(coalesce(imp, 0.0), 0.1) as imp, coalesce(freq, 0) as freq from (select inst, unnest(units) as u from z where idx = -1) a left join imp using (inst, u) left join freq using (inst, u)),
u1 as (select *, imp / max(imp) over (partition by inst) * (0.3 + 0.7 / (1 + freq)) as w from u0),
base as (select inst, sum(case when freq > 0 then w else 0.0 end) / (sum(w) + 1e-8) as base, count(*) as n_units from u1 group by inst),
hits as (select h.inst, h.idx, count(*) as hits from held h join u0 using (inst, u) group by all),
each as (select x.inst, base, coalesce(hits, 0)::double / n_units as c from x join base using (inst) left join hits on x.inst = hits.inst and x.idx = hits.idx where x.idx >= 0)
select inst as instance, round(greatest(0.0, least(1.0, any_value(base) * case when count(*) < 2 then 1.0 else greatest(0.3, 1 - exp(-3 * stddev_pop(c))) end)), 6) as kpig, round(avg(c), 6) as coverage from each group by inst""")
def key_point_coverage(spark, sf_dir):
    """Importance-weighted coverage of a conversation's first turn by its later ones."""
    t = turns(spark, sf_dir)
    base = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("reference"), F.min("turn").alias("t0"))
    r = t.join(base, "conv_id").where("turn > t0").select(F.col("conv_id").alias("instance"), F.col("turn").alias("idx"), "reference", F.col("text").alias("response"))
    return coverage.key_point_coverage(r)


@query()
def text_cleaning(spark, sf_dir):
    """Cleaned generations, parsed lines, truncation, sentences."""
    d = table(spark, sf_dir, "documents")
    sentences = F.filter(F.split(F.trim("text"), r"(?<=[.!?])\s+"), lambda s: text.word_count(s) >= 4)
    return d.select(
        "doc_id", F.md5(text.clean_generation(F.concat(F.lit("Rephrased version: "), "text"))).alias("clean_md5"), F.size(text.unmarked_lines(F.col("text"))).alias("n_lines"),
        F.length(text.truncated(F.col("text"), 1500, "...")).alias("n_cut"), F.size(sentences).alias("n_sentences"), F.md5(F.replace(F.col("text"), F.lit("\n"), F.lit(" "))).alias("flat_md5"),
    )


@query()
def evaluate_samples(spark, sf_dir):
    """A light evaluation without stored vectors, outputs or internals: drift, coverage, grounding, overlap, scores, diagnosis; evaluate_stored_samples is the whole one."""
    t = turns(spark, sf_dir)
    base = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("reference"), F.min("turn").alias("t0"))
    r = t.join(base, "conv_id").where("turn > t0")
    m = r.select("conv_id", text.word_count(F.col("text")).cast("double").alias("n"), text.word_count(F.col("reference")).alias("nr"), text.entities(F.col("reference")).alias("er"), text.entities(F.col("text")).alias("ea"), text.long_words(F.col("text")).alias("w"), text.long_words(F.col("reference")).alias("g"), overlap.rouge_l_score(F.col("text"), F.col("reference")).alias("rl"))
    share = F.coalesce(F.try_divide(F.size(F.array_except("w", "g")).cast("double"), F.size("w").cast("double")), F.lit(0.0))
    cover = F.when(F.size("er") == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect("er", "ea")).cast("double"), F.size("er").cast("double")))
    m = m.withColumns({"hs": share, "coverage": cover, "adequacy": scores.length_adequacy(F.col("n"), F.col("nr")), "jac": text.jaccard(F.col("w"), F.col("g"))})
    g = m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k"), F.avg("n").alias("avg_length"), F.var_pop("n").alias("vl"), F.avg("hs").alias("hs"), F.avg("coverage").alias("coverage"), F.avg(0.4 * F.col("jac") + 0.2 * F.col("adequacy") + 0.4 * F.col("coverage")).alias("cs"), F.avg("jac").alias("sms"), F.avg("rl").alias("rouge_l"), F.stddev_samp("rl").alias("sd"))
    c = F.col
    g = g.withColumns({"trd": F.when(c("k") < 2, 0.0).otherwise(F.coalesce(F.least(F.lit(1.0), F.try_divide(c("vl"), c("avg_length") * c("avg_length"))), F.lit(0.0))), "auc_e": F.when(c("k") < 2, c("rouge_l")).otherwise(scores.clamp01(1 - F.coalesce(F.try_divide(c("sd"), c("rouge_l")), F.lit(1.0)))), "faithfulness": 1 - c("hs")})
    g = g.withColumns({"pri": scores.pri(c("sms"), c("cs"), c("faithfulness"), c("avg_length")), "ori": scores.diagnostic_ori(c("sms"), c("auc_e"), c("trd"), c("coverage"))})
    flags = F.array_compact(F.array(F.when(c("cs") < 0.25, "irrelevant"), F.when(c("sms") < 0.1, "unstable"), F.when(c("hs") > 0.5, "hallucinated")))
    return g.select("conv_id", "k", *[F.round(x, 6).alias(x) for x in ("avg_length", "sms", "cs", "hs", "trd", "auc_e", "coverage", "faithfulness", "pri", "ori")], scores.diagnosis(c("ori"), F.lit(1.0)).alias("diagnosis"), scores.reliability(c("pri")).alias("label"), F.array_join(flags, ",").alias("flags"))


@query(f"""with {EXCHANGES}, k as (select conv_id, pos, answer, {WORDS.format('answer')} as r, {WORDS.format('question')} as i, 'm|' || conv_id || '|' || pos as k from x),
s as (select *, list_transform(range(0, 40), lambda j: case when ('0x' || substr(md5(k || '#' || j), 1, 8))::bigint / 4294967295.0::double < 0.7 then r[j % greatest(len(r), 1) + 1] else i[j % greatest(len(i), 1) + 1] end) as w from k)
select 'm' as model, cast(conv_id as varchar) as instance_id, cast(pos as integer) as variant_idx, md5(case when pos = 0 and answer <> '' then answer else array_to_string(list_filter(w, lambda v: v is not null), ' ') end) as response_md5 from s""")
def simulated_responses(spark, sf_dir):
    """Stored answers where there are some, simulated ones elsewhere."""
    from wordvane.operators.providers import SimulatorProvider, TableProvider, run_provider

    x = exchanges(spark, sf_dir).select(F.lit("m").alias("model"), F.col("conv_id").cast("string").alias("instance_id"), F.col("pos").cast("int").alias("variant_idx"), F.col("question").alias("input_text"), F.col("answer").alias("reference_output"))
    stored = x.where("variant_idx = 0").select("instance_id", "variant_idx", F.col("reference_output").alias("response"))
    out = run_provider(TableProvider(stored, ["instance_id", "variant_idx"]), x, SimulatorProvider())
    return out.select("model", "instance_id", "variant_idx", F.md5("response").alias("response_md5"))
