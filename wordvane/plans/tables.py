"""Queries over documents, embeddings, events and the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordvane.functions import fixed, scores, text, vectors
from wordvane.operators import stats
from wordvane.plans.catalog import query
from wordvane.plans.dialogue import TOKENS, WORDS
from wordvane.session import table
from wordvane.sources.stores import staged


def seeded(key: Column, seed: int = 42) -> Column:
    """An order that depends on seed and key alone, in every engine."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), key.cast("string")))


@query(f"""with d as (select doc_id, text, {WORDS.format('text')} as w, {TOKENS.format('text')} as t, regexp_extract_all(coalesce(text, ''), '([\\p{{L}}\\p{{N}}_]+)', 1) as r from documents)
select doc_id, len(w) as n_words, len(t) as n_tokens, len(list_distinct(list_filter(t, lambda x: length(x) >= 4))) as n_long, len(list_distinct(list_filter(r, lambda x: regexp_matches(x, '^[A-Z][A-Za-z0-9]+$')))) as n_entities,
 round(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))::double / greatest(length(text), 1), 6) as ascii_ratio, md5(array_to_string({WORDS.format('lower(text)')}[1:8], ' ')) as signature_md5 from d""")
def text_profile(spark, sf_dir):
    """F01, F02, F03, F05, F08, F11 over whole texts."""
    t = F.col("text")
    d = table(spark, sf_dir, "documents")
    big = lambda c: F.size(c).cast("long")
    return d.select("doc_id", text.word_count(t).cast("long").alias("n_words"), text.token_count(t).cast("long").alias("n_tokens"), big(text.long_words(t)).alias("n_long"), big(text.entities(t)).alias("n_entities"), F.round(text.ascii_ratio(t), 6).alias("ascii_ratio"), F.md5(text.signature(t)).alias("signature_md5"))


def bucket(n: Column) -> Column:
    return F.when(n < 400, "short").when(n <= 800, "medium").otherwise("long")


BUCKET = "case when n < 400 then 'short' when n <= 800 then 'medium' else 'long' end"


@query(f"""with d as (select lang, len({WORDS.format('text')}) as n from documents where trim(coalesce(text, '')) <> '') select lang, {BUCKET} as bucket, count(*) as docs, round(avg(n), 6) as mean_words from d group by all""")
def length_buckets(spark, sf_dir):
    """Documents by length bucket."""
    d = table(spark, sf_dir, "documents").where(F.trim(F.coalesce("text", F.lit(""))) != "").select("lang", text.word_count(F.col("text")).alias("n"))
    return d.groupBy("lang", bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("n"), 6).alias("mean_words"))


@query(f"""with d as (select doc_id, len({WORDS.format('text')}) as n, md5('42|' || doc_id::varchar) as h from documents),
b as (select *, {BUCKET} as bucket from d), r as (select *, row_number() over (partition by bucket order by h) as k from b),
f as (select *, k <= case bucket when 'long' then 34 else 33 end as first from r),
g as (select *, row_number() over (partition by first order by h) as fill, (select count(*) from f where first) as got from f)
select doc_id, bucket, first as from_stratum from g where first or fill <= 100 - got""")
def stratified_sample(spark, sf_dir):
    """100 documents, a third of each length bucket, the rest to long; a bucket's shortfall is filled from the others, in seeded order.

    The ranks that cut are top-k cuts; Spark keeps at most k rows of a bucket in each task before it ranks them.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", bucket(text.word_count(F.col("text"))).alias("bucket"), seeded(F.col("doc_id")).alias("h"))
    quota = F.when(F.col("bucket") == "long", 34).otherwise(33)
    # More than 100 of a bucket are never needed, in its own share or to fill others'.
    near = d.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("h"))).where("k <= 134").withColumn("first", F.col("k") <= quota)
    got = near.where("first").agg(F.count(F.lit(1)).alias("got"))
    fill = F.row_number().over(Window.partitionBy("first").orderBy("h"))
    out = near.withColumn("fill", fill).crossJoin(F.broadcast(got))  # one number
    return out.where(F.col("first") | (F.col("fill") <= 100 - F.col("got"))).select("doc_id", "bucket", F.col("first").alias("from_stratum"))


@query("""select doc_id, md5('7|' || doc_id::varchar) as spot from documents order by spot limit 200""")
def seeded_sample(spark, sf_dir):
    """The first 200 rows of a seeded shuffle."""
    return table(spark, sf_dir, "documents").select("doc_id", seeded(F.col("doc_id"), 7).alias("spot")).orderBy("spot").limit(200)


@query("""with p as (select item_id, text, row_number() over (order by item_id) - 1 as k, count(*) over () as n from benchmark),
d as (select doc_id, (row_number() over (order by doc_id) - 1) as i from documents)
select doc_id, p.item_id as instruction_id from d join p on d.i % p.n = p.k""")
def round_robin(spark, sf_dir):
    """Instance i gets instruction i modulo the pool's size. Positions are counted over ranges of ids, not in one task."""
    pool = table(spark, sf_dir, "benchmark").select("item_id")
    n = pool.count()
    pool = pool.withColumn("k", F.row_number().over(Window.orderBy("item_id")) - 1)
    d = positions(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "i")
    return d.join(F.broadcast(pool) if n <= 100_000 else pool, F.pmod(F.col("i"), F.lit(max(n, 1))) == F.col("k")).select("doc_id", F.col("item_id").alias("instruction_id"))


def positions(df: DataFrame, key: str, out: str, width: int = 4096, most: int = 10_000) -> DataFrame:
    """df with the 0-based position by a whole-number key: counts of key ranges first, then ranks inside each range. Ranges are `width` keys wide, or
    so wide that there are `most` of them, however sparse the keys: one task sums that many counts."""
    ends = df.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    low, high = ends["a"] or 0, ends["b"] or 0
    width = max(width, -(-(high - low + 1) // most))
    df = df.withColumn("_range", F.floor((F.col(key) - low) / width))
    starts = df.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return df.join(starts, "_range").withColumn(out, F.col("_start") + inside).drop("_range", "_start")


@query(f"""with d as (select doc_id, source, array_to_string({WORDS.format('lower(text)')}[1:8], ' ') as sig from documents), r as (select *, row_number() over (partition by source, sig order by doc_id) as k from d) select doc_id, source from r where k = 1""")
def dedup_signature(spark, sf_dir):
    """The first document of each signature within its source, as a minimum: no key's rows meet in one task unreduced."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", text.signature(F.col("text")).alias("sig"))
    return d.groupBy("source", "sig").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query("""with p as (select *, replace(text, 'zzz', '') as t from benchmark), s as (select item_id, text, regexp_extract(text, '^(\\S+)', 1) as old from p)
select item_id, md5(case when strpos(text, old) > 0 then substr(text, 1, strpos(text, old) - 1) || 'PARA' || substr(text, strpos(text, old) + length(old)) else 'PARA' || chr(10) || chr(10) || text end) as prompt_md5,
 md5('Summarize the following text.' || chr(10) || chr(10) || text) as template_md5, contains('PARA' || text, 'PARA') as has_paraphrase from s""")
def first_occurrence_substitution(spark, sf_dir):
    """the first word of each prompt replaced once; a prompt template."""
    b = table(spark, sf_dir, "benchmark").withColumn("old", F.regexp_extract("text", r"^(\S+)", 1))
    new = text.substitute_first(F.col("text"), F.col("old"), F.lit("PARA"))
    return b.select("item_id", F.md5(new).alias("prompt_md5"), F.md5(F.concat(F.lit("Summarize the following text.\n\n"), "text")).alias("template_md5"), new.contains("PARA").alias("has_paraphrase"))


@query("""select doc_id, md5(regexp_replace(text, '(?is)^((?:|.*?[^\\p{L}\\p{N}_])(?:is|are|was|were|am|be|been|being))($|[^\\p{L}\\p{N}_])', '\\1 not not\\2')) as variant_md5 from documents""")
def perturb_double_negation(spark, sf_dir):
    """F25 over whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.double_negation(F.col("text"))).alias("variant_md5"))


def _formality_sql() -> str:
    q = lambda s: s.replace("'", "''")
    long = " + ".join(f"contains(p, '{q(a)}')::int" for a, _ in fixed.CONTRACTIONS)
    short = " + ".join(f"contains(p, '{q(b)}')::int" for _, b in fixed.CONTRACTIONS)
    c, e = "p", "p"
    for a, b in fixed.CONTRACTIONS:
        c, e = f"replace({c}, '{q(a)}', '{q(b)}')", f"replace({e}, '{q(b)}', '{q(a)}')"
    return f"with d as (select doc_id, ' ' || text || ' ' as p from documents) select doc_id, md5(trim(case when {long} >= {short} then {c} else {e} end)) as variant_md5 from d"


@query(_formality_sql())
def perturb_formality(spark, sf_dir):
    """F27 over whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.formality_shift(F.col("text"))).alias("variant_md5"))


PROMPTS = ("Answer in 50 words, as a short list.", "Give a detailed, comprehensive report.", "Limit to 10 words, brief", "Tell me more.")


@query(f"""with p as (select unnest([{', '.join(f"'{x}'" for x in PROMPTS)}]) as prompt),
c as (select prompt, try_cast(regexp_extract(lower(prompt), '(?:in|under|maximum|max|limit to)\\s+([0-9]+)\\s+words?', 1) as double) as lim, case when regexp_matches(lower(prompt), '\\b(short|brief|concise)\\b') then 'short' when regexp_matches(lower(prompt), '\\b(detailed|long|comprehensive)\\b') then 'long' end as len, regexp_matches(lower(prompt), '\\b(bullet points|bullets|list)\\b') as lst from p),
d as (select doc_id, text, len({WORDS.format('text')})::double as n from documents),
s as (select doc_id, prompt, list_filter([case when lim is null then null when n <= lim * 1.1 then 1.0 when lim = 0 then 0.0 else greatest(0.0, 1 - (n - lim) / lim) end, case len when 'short' then case when n < 100 then 1.0 else 0.5 end when 'long' then case when n >= 50 then 1.0 else 0.5 end end,
 case when lst then case when regexp_matches(text, '(^|\\n)(\\s*[-*•]\\s|\\s*[0-9]+\\.\\s)') then 1.0 else 0.0 end end]::double[], lambda x: x is not null) as parts from d, c)
select doc_id, prompt, round(case when len(parts) = 0 then 1.0 else list_sum(parts) / len(parts) end, 6) as compliance from s""")
def constraint_compliance(spark, sf_dir):
    """A short literal list of prompts against every document."""
    read = table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n"), text.is_list(F.col("text")).alias("listed"))
    prompts = F.array(*[F.struct(F.lit(p).alias("prompt"), text.constraints(F.lit(p)).alias("asked")) for p in PROMPTS])
    d = read.select("doc_id", "n", "listed", F.explode(prompts).alias("p"))
    return d.select("doc_id", "p.prompt", F.round(text.compliance_of(F.col("n"), F.col("listed"), F.col("p.asked")), 6).alias("compliance"))


# Embeddings: an instance is a label, or a run of eight vectors where pairs are compared.
def embedded(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", "label", vectors.doubles(F.col("embedding")).alias("v"))


def centroids(e: DataFrame, key: str, v: str = "v") -> DataFrame:
    """Element-wise mean of each group's vectors: positions are averaged apart, with partial sums on the way."""
    long = e.select(key, F.posexplode(v).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


CENTRE = """e as (select vec_id, label, embedding::double[] as v from embeddings where embedding is not null),
u as (select *, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-8)) as u from e),
p as (select label, i, avg(u[i]) as m, avg(v[i]) as mv from u, (select unnest(range(1, 65)) as i) group by label, i),
c as (select label, list(m order by i) as m, list(mv order by i) as mv from p group by label)"""
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"


@query(f"""with {CENTRE}, k as (select label, count(*)::double as k from e group by label),
t as (select u.label, avg(1 - {DOT.format('u.v', 'c.mv')} / (sqrt({DOT.format('u.v', 'u.v')}) * sqrt({DOT.format('c.mv', 'c.mv')}))) as trd from u join c using (label) group by u.label)
select c.label, k::bigint as k, round(case when k < 2 then 1.0 else (k * k * {DOT.format('m', 'm')} - k) / (k * (k - 1)) - 0.5 * (1 - {DOT.format('m', 'm')}) end, 6) as sms_raw, round(case when k < 2 then 1.0 else least(1.0, greatest(0.0, (k * k * {DOT.format('m', 'm')} - k) / (k * (k - 1)) - 0.5 * (1 - {DOT.format('m', 'm')}))) end, 6) as sms, round(case when k < 2 then 0.0 else trd end, 6) as trd
from c join k using (label) join t using (label)""")
def consistency_by_label(spark, sf_dir):
    """For unit vectors the mean pairwise cosine follows from the centroid's norm, so no pairs are made."""
    e = embedded(spark, sf_dir).withColumn("u", vectors.unit(F.col("v")))
    c = centroids(e, "label", "u").withColumn("m2", vectors.dot(F.col("centroid"), F.col("centroid"))).select("label", "m2")
    k = e.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("k"))
    trd = e.join(centroids(e, "label"), "label").groupBy("label").agg(F.avg(1 - vectors.cosine(F.col("v"), F.col("centroid"))).alias("t"))
    n, m2 = F.col("k"), F.col("m2")
    raw = F.when(n < 2, 1.0).otherwise(F.try_divide(n * n * m2 - n, n * (n - 1)) - 0.5 * (1 - m2))
    return c.join(k, "label").join(trd, "label").select("label", n.cast("long").alias("k"), F.round(raw, 6).alias("sms_raw"), F.round(scores.clamp01(raw), 6).alias("sms"), F.round(F.when(n < 2, 0.0).otherwise(F.col("t")), 6).alias("trd"))


@query(f"""with e as (select vec_id, vec_id // 8 as inst, embedding::double[] as v from embeddings where embedding is not null),
p as (select a.inst, a.vec_id as i, b.vec_id as j, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as d, {DOT.format('a.v', 'b.v')} / (sqrt({DOT.format('a.v', 'a.v')}) * sqrt({DOT.format('b.v', 'b.v')})) as cos from e a join e b on a.inst = b.inst and a.vec_id < b.vec_id)
select inst, round(1 - avg(d) / 2, 6) as sms_w, round(avg(cos), 6) as mean_cosine, round(max(cos), 6) as best_cosine from p group by inst""")
def pairwise_vectors(spark, sf_dir):
    """Pairs within runs of eight vectors."""
    e = embedded(spark, sf_dir).withColumn("inst", F.floor(F.col("vec_id") / 8))
    a, b = e.select("inst", F.col("vec_id").alias("i"), F.col("v").alias("a")), e.select(F.col("inst").alias("_i"), F.col("vec_id").alias("j"), F.col("v").alias("b"))
    p = a.join(b, (F.col("inst") == F.col("_i")) & (F.col("i") < F.col("j")))
    cos = vectors.cosine(F.col("a"), F.col("b"))
    return p.groupBy("inst").agg(F.round(1 - F.avg(vectors.distance(F.col("a"), F.col("b"))) / 2, 6).alias("sms_w"), F.round(F.avg(cos), 6).alias("mean_cosine"), F.round(F.max(cos), 6).alias("best_cosine"))


@query(f"""with e as (select vec_id, vec_id // 8 as inst, row_number() over (partition by vec_id // 8 order by vec_id) as k, embedding::double[] as v from embeddings where embedding is not null),
p as (select r.inst, r.vec_id as ref, s.vec_id as unit, {DOT.format('r.v', 's.v')} / (sqrt({DOT.format('r.v', 'r.v')}) * sqrt({DOT.format('s.v', 's.v')})) as sim from e r join e s on r.inst = s.inst and r.k <= 3 and s.k > 3),
b as (select inst, ref, arg_max(unit, (sim, -unit)) as unit, max(sim) as sim from p group by all)
select inst, ref, unit, round(sim, 6) as sim, sim >= 0.05 as matched, round(max(least(1.0, greatest(0.0, sim))) over (partition by inst), 6) as multi_reference from b""")
def best_match_units(spark, sf_dir):
    """For each of three references of an instance its most similar response, the first of equals."""
    e = embedded(spark, sf_dir).withColumn("inst", F.floor(F.col("vec_id") / 8)).withColumn("k", F.row_number().over(Window.partitionBy("inst").orderBy("vec_id")))
    r = e.where("k <= 3").select("inst", F.col("vec_id").alias("ref"), F.col("v").alias("rv"))
    s = e.where("k > 3").select("inst", F.col("vec_id").alias("unit"), F.col("v").alias("sv"))
    p = r.join(s, "inst").withColumn("sim", vectors.cosine(F.col("rv"), F.col("sv")))
    b = p.groupBy("inst", "ref").agg(F.max_by("unit", F.struct("sim", -F.col("unit"))).alias("unit"), F.max("sim").alias("sim"))
    return b.select("inst", "ref", "unit", F.round("sim", 6).alias("sim"), (F.col("sim") >= 0.05).alias("matched"), F.round(F.max(scores.clamp01(F.col("sim"))).over(Window.partitionBy("inst")), 6).alias("multi_reference"))


SIMS = f"{CENTRE}, s as (select u.label, {DOT.format('u.v', 'c.mv')} / (sqrt({DOT.format('u.v', 'u.v')}) * sqrt({DOT.format('c.mv', 'c.mv')})) as sim from u join c using (label))"


def similarities(spark, sf_dir) -> DataFrame:
    e = embedded(spark, sf_dir)
    return e.join(centroids(e, "label"), "label").select("label", "vec_id", vectors.cosine(F.col("v"), F.col("centroid")).alias("sim"))


EDGES = list(enumerate(zip(fixed.HISTOGRAM_EDGES, fixed.HISTOGRAM_EDGES[1:])))
LAST = EDGES[-1][0]


@query(f"""with s as (select 0.65::double + l_discount::double * 3.6::double as sim from lineitem), b as (select * from (values {', '.join(f"({i}, {lo!r}::double, {hi!r}::double)" for i, (lo, hi) in EDGES)}) t(bin, lo, hi))
select b.bin, count(s.sim) as n from b left join s on s.sim >= b.lo and (s.sim < b.hi or b.bin = {LAST} and s.sim = b.hi) group by b.bin""")
def similarity_histogram(spark, sf_dir):
    """The fixed bins of a report: left-closed, the last closed on both sides, empty ones too. A line's discount stands in for its similarity."""
    s = table(spark, sf_dir, "lineitem").select((F.lit(0.65) + F.col("l_discount").cast("double") * F.lit(3.6)).alias("sim"))
    bin_of = F.lit(None).cast("int")
    for i, (lo, hi) in EDGES:
        bin_of = F.when((F.col("sim") >= lo) & ((F.col("sim") <= hi) if i == LAST else (F.col("sim") < hi)), i).otherwise(bin_of)
    n = s.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(len(EDGES)).select(F.col("id").cast("int").alias("bin")).join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"with {SIMS} select label, count(*) as n, count(*) filter (sim < {fixed.SIMILARITY_LOW}) as below, round(avg(sim), 6) as mean, round(stddev_pop(sim), 6) as std, round(min(sim), 6) as least, round(max(sim), 6) as most, case when count(*) filter (sim < {fixed.SIMILARITY_LOW}) > 0 then 'warning' else 'ok' end as severity from s group by label")
def similarity_findings(spark, sf_dir):
    """Q02: similarities below the general bound are warnings, whatever the task."""
    r = lambda c, name: F.round(c, 6).alias(name)
    below = F.count(F.when(F.col("sim") < fixed.SIMILARITY_LOW, 1))
    g = similarities(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), below.alias("below"), r(F.avg("sim"), "mean"), r(F.stddev_pop("sim"), "std"), r(F.min("sim"), "least"), r(F.max("sim"), "most"))
    return g.withColumn("severity", F.when(F.col("below") > 0, "warning").otherwise("ok"))


@query(f"""with {SIMS} select label, count(*) as n, round(avg(sim), 6) as mean, round(stddev_pop(sim), 6) as std, round(min(sim), 6) as least, round(max(sim), 6) as most, round(quantile_cont(sim, 0.25), 6) as p25, round(quantile_cont(sim, 0.75), 6) as p75 from s group by label""")
def dataset_stats(spark, sf_dir):
    """Similarity statistics of each group, with exact interpolated percentiles."""
    r = lambda c, name: F.round(c, 6).alias(name)
    s = staged(similarities(spark, sf_dir))
    g = s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r(F.avg("sim"), "mean"), r(F.stddev_pop("sim"), "std"), r(F.min("sim"), "least"), r(F.max("sim"), "most"))
    return g.join(stats.exact_percentiles(s, "label", "sim", {"p25": 0.25, "p75": 0.75}).select("label", r("p25", "p25"), r("p75", "p75")), "label")


def band(sim: Column, task: Column) -> Column:
    """Whether a similarity is in its task's band."""
    low = F.lit(fixed.SIMILARITY_LOW)
    for t, x in fixed.SIMILARITY_LOW_BY_TASK.items():
        low = F.when(task == t, x).otherwise(low)
    return (sim >= low) & (sim <= fixed.SIMILARITY_HIGH)


#: The last is no task that strategies are listed for.
TASKS = ("summarization", "creative", "dialogue", "qa", "other")
_allowed = " union all ".join(f"select '{t}' as task, '{s}' as strategy" for t, ss in fixed.STRATEGIES_BY_TASK.items() for s in ss)


@query(f"""with s as (select l.l_orderkey, l.l_linenumber, (['summarization', 'creative', 'dialogue', 'qa', 'other'])[l_orderkey % 5 + 1] as task, ([{', '.join(f"'{x}'" for x in fixed.STRATEGIES)}])[l_partkey % 16 + 1] as strategy, 0.75 + l_discount::double * 2.4 as sim from lineitem l),
a as ({_allowed})
select s.task, s.strategy, count(*) as accepted from s where (exists (select 1 from a where a.task = s.task and a.strategy = s.strategy) or not exists (select 1 from a where a.task = s.task)) and sim >= case when task = 'dialogue' then 0.78 else 0.82 end and sim <= 0.98 group by all""")
def band_and_whitelist(spark, sf_dir):
    """Band gate per task, and a left semi join with the strategies a task allows; a task that none are listed for allows all."""
    at = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (k + 1).cast("int"))
    s = table(spark, sf_dir, "lineitem").select(at(TASKS, F.col("l_orderkey") % 5).alias("task"), at(fixed.STRATEGIES, F.col("l_partkey") % 16).alias("strategy"), (0.75 + F.col("l_discount").cast("double") * 2.4).alias("sim"))
    allowed = spark.createDataFrame([(t, x) for t, xs in fixed.STRATEGIES_BY_TASK.items() for x in xs], "task string, strategy string")
    s = s.where(band(F.col("sim"), F.col("task")))
    known = F.col("task").isin(*fixed.STRATEGIES_BY_TASK)
    kept = s.where(known).join(F.broadcast(allowed), ["task", "strategy"], "left_semi").unionByName(s.where(~known))  # a constant table of 45 rows
    return kept.groupBy("task", "strategy").agg(F.count(F.lit(1)).alias("accepted"))


@query("select doc_id, lang, source from documents order by doc_id limit 100")
def first_rows(spark, sf_dir):
    """The first n rows by id; 0 takes all."""
    return limited(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), 100, "doc_id")


def limited(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order; all where n is 0."""
    return df.orderBy(*order).limit(n) if n else df


@query("select d.doc_id, d.n_chars, c.conv_id, c.turn from conversations c join documents d on d.doc_id = c.conv_id * 3 + c.turn")
def row_lookup(spark, sf_dir):
    """Texts looked up by their row number, all in one join."""
    wanted = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 3 + F.col("turn")).alias("doc_id"))
    return wanted.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "n_chars", "conv_id", "turn")


NUMERICS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" union all ".join(f"select '{c}' as metric, round(avg({c}::double), 6) as mean, round(stddev_pop({c}::double), 6) as std, round(min({c}::double), 6) as least, round(max({c}::double), 6) as most, round(quantile_cont({c}::double, 0.5), 6) as median, count({c}) as n from lineitem" for c in NUMERICS))
def metric_summary(spark, sf_dir):
    """A05, unpivot: summary statistics of each metric; nulls are left out."""
    r = lambda c, name: F.round(c, 6).alias(name)
    v = F.col("value")
    long = unpivoted(spark, sf_dir)
    g = long.groupBy("metric").agg(r(F.avg(v), "mean"), r(F.stddev_pop(v), "std"), r(F.min(v), "least"), r(F.max(v), "most"), F.count(v).alias("n"))
    return g.join(stats.exact_percentiles(long, "metric", "value", {"median": 0.5}).select("metric", r("median", "median")), "metric")


def unpivoted(spark, sf_dir) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in NUMERICS])
    return wide.unpivot([], list(NUMERICS), "metric", "value")


@query("with s as (" + " union all ".join(f"select '{c}' as metric, avg({c}::double / 100) as mean, stddev_samp({c}::double / 100) as std from lineitem" for c in NUMERICS) + ") select metric, round(mean, 6) as mean, round(std, 6) as std, case when std < 0.1 then 'Stable' when std <= 0.2 then 'Moderate' else 'Unstable' end as label from s")
def stability_table(spark, sf_dir):
    """Mean and sample deviation of each metric, labelled."""
    g = unpivoted(spark, sf_dir).groupBy("metric").agg(F.avg(F.col("value") / 100).alias("mean"), F.stddev_samp(F.col("value") / 100).alias("std"))
    return g.select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), scores.stability(F.col("std")).alias("label"))


def average_rank(value: str) -> Column:
    """Rank from 1 in falling order, ties share the mean of their ranks."""
    return F.rank().over(Window.orderBy(F.desc(value))).cast("double") + (F.count(F.lit(1)).over(Window.partitionBy(value)).cast("double") - 1) / 2


@query("""select l_suppkey, sum(l_quantity)::double as s, cast(floor(rank() over (order by sum(l_quantity) desc) + (count(*) over (partition by sum(l_quantity)) - 1) / 2.0) as integer) as rank from lineitem group by l_suppkey""")
def average_ranks(spark, sf_dir):
    """Average ranks, cut to whole numbers, from counts of distinct values in slices."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").cast("double").alias("s"))
    g = staged(g.select("l_suppkey", "s", (-F.col("s")).alias("_less"), F.lit(0).alias("_k")))
    return g.join(stats.tie_ranks(g, "_k", "_less").withColumnRenamed("rank", "_rank"), ["_k", "_less"]).select("l_suppkey", "s", F.floor("_rank").cast("int").alias("rank"))


@query("""select o.o_orderkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_quantity > 45)""")
def resume_pending(spark, sf_dir):
    """Keys that aren't stored yet, by left anti join of pruned key columns."""
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("""select o.o_orderkey, coalesce(l.n, 0) as hits, case when l.n is null then 'generated' else 'cached' end as origin from orders o left join (select l_orderkey, count(*) as n from lineitem where l_tax > 0.05 group by 1) l on o.o_orderkey = l.l_orderkey""")
def cache_lookup(spark, sf_dir):
    """Left join with a cache; misses are filled in."""
    cache = table(spark, sf_dir, "lineitem").where("l_tax > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(cache, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("hits"), F.when(F.col("n").isNull(), "generated").otherwise("cached").alias("origin"))


@query("""with a as (select o_custkey as k from orders where o_totalprice > 200000), b as (select o_custkey as k from orders where o_totalprice < 50000)
select 'union_all' as op, count(*) as n from (select * from a union all select * from b) union all select 'intersect', count(*) from (select k from a intersect select k from b) union all select 'except', count(*) from (select k from a except select k from b)""")
def set_operations(spark, sf_dir):
    """U01, U02, U04 on keys."""
    o = table(spark, sf_dir, "orders")
    a, b = o.where("o_totalprice > 200000").select("o_custkey"), o.where("o_totalprice < 50000").select("o_custkey")
    counted = lambda name, d: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return counted("union_all", a.unionByName(b)).unionByName(counted("intersect", a.intersect(b))).unionByName(counted("except", a.subtract(b)))


@query("""select doc_id, md5(md5_in) as k, round(('0x' || left(md5(md5_in), 8))::bigint / 4294967295.0, 6) as u from (select doc_id, doc_id::varchar || ':' || coalesce(lang, '') as md5_in from documents)""")
def hashed_uniform(spark, sf_dir):
    """Key hashes and the uniform number they give."""
    d = table(spark, sf_dir, "documents").withColumn("i", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("lang", F.lit(""))))
    return d.select("doc_id", F.md5("i").alias("k"), F.round(text.hashed_uniform(F.col("i")), 6).alias("u"))


@query("""select event_type, count(*) as n, round(avg((props::json->>'k')::double), 6) as mean_k, max((props::json->>'k')::bigint) as most_k from events group by event_type""")
def json_columns(spark, sf_dir):
    """A JSON text column, decoded by schema."""
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p.k"), 6).alias("mean_k"), F.max("p.k").alias("most_k"))


@query(f"""with d as (select lang, source, doc_id, len({WORDS.format('text')}) as n from documents), v as (select lang, source, list(struct_pack(i := doc_id, n := n) order by doc_id) as vs from d group by all),
k as (select lang, source, list_filter(vs, lambda x: x.n >= 100) as vs from v)
select lang, source, len(vs) as n_variants, list_sum(list_transform(vs, lambda x: x.n))::bigint as words, vs[1].i as first_variant from k where len(vs) > 0""")
def nested_bridge(spark, sf_dir):
    """Numbers and words of the long enough documents of each language and source, and the first of them."""
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", text.word_count(F.col("text")).alias("n")).where("n >= 100")
    g = d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_variants"), F.sum("n").alias("words"), F.min("doc_id").alias("first_variant"))
    return g


@query("""select coalesce(event_type, 'none') as model, 'L' || lvl as level, sum(case lvl when 1 then value else value * 2 end)::double as total from events, (select unnest([1, 2]) as lvl) group by all""")
def map_flatten(spark, sf_dir):
    """A map of levels to values, exploded to long rows."""
    e = table(spark, sf_dir, "events").select(F.coalesce("event_type", F.lit("none")).alias("model"), F.explode(F.create_map(F.lit("L1"), F.col("value"), F.lit("L2"), F.col("value") * 2)).alias("level", "x"))
    return e.groupBy("model", "level").agg(F.sum("x").alias("total"))


@query("""with s as (select unnest(range(0, 12)) as slot), p as (select event_type, row_number() over (order by event_type) - 1 as k, count(*) over () as n from (select distinct event_type from events where event_type is not null))
select slot, event_type from s join p on s.slot % p.n = p.k""")
def cycle_fill(spark, sf_dir):
    """A small pool of distinct values cycled to twelve slots."""
    kinds = table(spark, sf_dir, "events").where("event_type is not null").select("event_type").distinct()
    pool = kinds.withColumn("k", F.row_number().over(Window.orderBy("event_type")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    slots = spark.range(12).select(F.col("id").alias("slot"))
    return slots.join(pool, F.pmod("slot", "n") == F.col("k")).select("slot", "event_type")


@query("""with n as (select count(*) as n from nation), s as (select cast(floor(i * (n - 1) / 4.0) as bigint) as k from n, (select unnest(range(0, 5)) as i)), r as (select n_nationkey, row_number() over (order by n_nationkey) - 1 as k from nation)
select n_nationkey, r.k < 10 as dev from r join s on r.k = s.k""")
def evenly_spaced(spark, sf_dir):
    """Five evenly spaced rows of an ordered small table; its first ten are the development part."""
    t = table(spark, sf_dir, "nation").select("n_nationkey")
    ranked = t.withColumn("k", F.row_number().over(Window.orderBy("n_nationkey")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    spots = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(i * (F.col("n") - 1) / F.lit(4.0)))
    return ranked.where(F.array_contains(spots, F.col("k").cast("long"))).select("n_nationkey", (F.col("k") < 10).alias("dev"))


@query("""select coalesce(nullif(c_mktsegment, ''), 'idx_' || c_custkey::varchar) as instance_id, count(*) as n, case when avg(c_acctbal::double) / 10000 >= 0.7 then 'green' when avg(c_acctbal::double) / 10000 >= 0.4 then 'yellow' else 'red' end as colour from customer group by 1""")
def default_ids(spark, sf_dir):
    """Default where a key is missing; colour ladder."""
    c = table(spark, sf_dir, "customer")
    key = F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("")), F.concat(F.lit("idx_"), F.col("c_custkey").cast("string")))
    return c.groupBy(key.alias("instance_id")).agg(F.count(F.lit(1)).alias("n"), scores.colour(F.avg(F.col("c_acctbal").cast("double")) / 10000).alias("colour"))
