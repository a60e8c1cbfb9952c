"""Queries over groups of texts: an instance is a conversation, its variants or responses are its turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordvane.functions import fixed, scores, text
from wordvane.plans.catalog import query
from wordvane.session import table

# SQL pieces that several oracles share.
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '([\\p{{L}}\\p{{N}}_]+)', 1)"
WORDS = "list_filter(string_split_regex(coalesce({0}, ''), '\\s+'), lambda w: w <> '')"
COMMON = ", ".join(f"'{w}'" for w in fixed.COMMON_WORDS)


def turns(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


#: Members of a group that one tile of its pairs takes from either side, about.
PAIR_TILE = 256


def pairs_within(items: DataFrame, key: str, index: str, *columns: str, tile: int = PAIR_TILE) -> DataFrame:
    """Unordered pairs of a group's members, i before j, by an equi-join on tiles: members are dealt to blocks, and each pair of blocks is a key of its own,
    so that a huge group is many tasks. A group of one block is one key."""
    blocks = items.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_blocks"))
    dealt = items.select(key, F.col(index).alias("_i"), *columns).join(blocks, key).withColumn("_b", F.pmod(F.xxhash64("_i"), F.col("_blocks")).cast("int"))
    left = dealt.withColumn("_c", F.explode(F.sequence(F.col("_b"), F.col("_blocks") - 1))).select(F.col(key), "_b", "_c", "_i", *columns)
    right = dealt.withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_b")))).select(F.col(key).alias("_key"), "_a", F.col("_b").alias("_d"), F.col("_i").alias("_j"), *[F.col(c).alias(f"_{c}") for c in columns])
    same_tile = (F.col(key) == F.col("_key")) & (F.col("_b") == F.col("_a")) & (F.col("_c") == F.col("_d"))
    met = left.join(right, same_tile & ((F.col("_b") < F.col("_c")) | (F.col("_i") < F.col("_j"))) & (F.col("_i") != F.col("_j")))
    first = F.col("_i") < F.col("_j")  # of two blocks either may hold the earlier member
    either = lambda x, y: [F.when(first, F.col(x)).otherwise(F.col(y)), F.when(first, F.col(y)).otherwise(F.col(x))]
    out = [F.col(key)] + [x.alias(n) for x, n in zip(either("_i", "_j"), ("i", "j"), strict=True)]
    for c in columns:
        out += [x.alias(f"{c}_{n}") for x, n in zip(either(c, f"_{c}"), ("i", "j"), strict=True)]
    return met.select(*out)


def exchanges(spark, sf_dir: str) -> DataFrame:
    """User turns zipped with the assistant turns of the same conversation by position; the shorter side ends the zip."""
    place = Window.partitionBy("conv_id", "role").orderBy("turn")
    t = turns(spark, sf_dir).withColumn("pos", F.row_number().over(place) - 1)
    ask = t.where("role = 'user'").select("conv_id", "pos", F.col("text").alias("question"))
    answer = t.where("role = 'assistant'").select("conv_id", "pos", F.col("text").alias("answer"))
    return ask.join(answer, ["conv_id", "pos"])


EXCHANGES = """t as (select *, row_number() over (partition by conv_id, role order by turn) - 1 as pos from conversations),
x as (select a.conv_id, a.pos, a.text as question, b.text as answer from t a join t b on a.conv_id = b.conv_id and a.pos = b.pos and a.role = 'user' and b.role = 'assistant')"""


@query(f"""with t as (select conv_id, turn, {TOKENS.format('text')} as w from conversations),
p as (select a.conv_id, a.turn as i, b.turn as j, len(list_distinct(a.w)) as na, len(list_distinct(b.w)) as nb, len(list_intersect(list_distinct(a.w), list_distinct(b.w))) as common from t a join t b on a.conv_id = b.conv_id and a.turn < b.turn)
select conv_id, i, j, round(case when na = 0 or nb = 0 then 0.0 else common::double / (na + nb - common) end, 6) as jaccard from p""")
def pairwise_jaccard(spark, sf_dir):
    """Token Jaccard of all pairs of turns."""
    t = turns(spark, sf_dir).withColumn("w", F.array_distinct(text.tokens(F.col("text"))))
    return pairs_within(t, "conv_id", "turn", "w").select("conv_id", "i", "j", F.round(text.jaccard(F.col("w_i"), F.col("w_j")), 6).alias("jaccard"))


@query(f"""with t as (select conv_id, turn, {TOKENS.format('text')} as w from conversations),
b as (select conv_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) as bigram from t),
d as (select conv_id, count(distinct bigram)::double / count(*) as d2 from b group by conv_id),
p as (select a.conv_id, avg(case when len(a.w) = 0 or len(b.w) = 0 then 0.0 else len(list_intersect(list_distinct(a.w), list_distinct(b.w)))::double / len(list_distinct(a.w || b.w)) end) as o from t a join t b on a.conv_id = b.conv_id and a.turn < b.turn group by a.conv_id),
n as (select conv_id, count(*) as k, count(distinct role) as n_strategies from conversations group by conv_id)
select n.conv_id, round(case when k < 2 then 0.0 else coalesce(d2, 0.0) end, 6) as distinct_2, round(coalesce(o, 0.0), 6) as mean_pairwise_overlap, n_strategies from n left join d using (conv_id) left join p using (conv_id)""")
def diversity(spark, sf_dir):
    """Distinct-2 and mean pairwise overlap of each instance; 0 with fewer than two texts."""
    t = turns(spark, sf_dir).withColumn("w", text.tokens(F.col("text")))
    grams = t.select("conv_id", F.explode(text.bigrams(F.col("w"))).alias("g")).groupBy("conv_id").agg((F.count_distinct("g") / F.count("g")).alias("d2"))
    overlap = pairs_within(t, "conv_id", "turn", "w").groupBy("conv_id").agg(F.avg(text.jaccard(F.col("w_i"), F.col("w_j"))).alias("o"))
    n = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k"), F.count_distinct("role").alias("n_strategies"))
    out = n.join(grams, "conv_id", "left").join(overlap, "conv_id", "left")
    return out.select("conv_id", F.round(F.when(F.col("k") < 2, 0.0).otherwise(F.coalesce("d2", F.lit(0.0))), 6).alias("distinct_2"), F.round(F.coalesce("o", F.lit(0.0)), 6).alias("mean_pairwise_overlap"), "n_strategies")


TF = f"""w as (select conv_id, turn, unnest({TOKENS.format('text')}) as word from conversations),
f as (select conv_id, turn, word, count(*)::double as n from w group by all),
l as (select conv_id, turn, sqrt(sum(n * n)) as len from f group by all),
d as (select a.conv_id, a.turn as i, b.turn as j, sum(a.n * b.n) as dot from f a join f b on a.conv_id = b.conv_id and a.word = b.word and a.turn < b.turn group by all),
p as (select a.conv_id, a.turn as i, b.turn as j from conversations a join conversations b on a.conv_id = b.conv_id and a.turn < b.turn),
s as (select p.conv_id, p.i, p.j, coalesce(dot / (x.len * y.len), 0.0) as sim from p left join d on p.conv_id = d.conv_id and p.i = d.i and p.j = d.j left join l x on p.conv_id = x.conv_id and p.i = x.turn left join l y on p.conv_id = y.conv_id and p.j = y.turn)"""


def tf_pairs(t: DataFrame) -> DataFrame:
    """conv_id, i, j, sim: term-frequency cosine of all pairs of a group, by joining counts on words."""
    f = t.select("conv_id", "turn", F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("conv_id", "turn", "word").agg(F.count(F.lit(1)).cast("double").alias("n"))
    length = f.groupBy("conv_id", "turn").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    a = f.select("conv_id", "word", F.col("turn").alias("i"), F.col("n").alias("n_i"))
    b = f.select("conv_id", "word", F.col("turn").alias("j"), F.col("n").alias("n_j"))
    dots = a.join(b, ["conv_id", "word"]).where("i < j").groupBy("conv_id", "i", "j").agg(F.sum(F.col("n_i") * F.col("n_j")).alias("dot"))
    p = pairs_within(t, "conv_id", "turn").join(dots, ["conv_id", "i", "j"], "left")
    for side in "ij":
        p = p.join(length.select("conv_id", F.col("turn").alias(side), F.col("len").alias(f"len_{side}")), ["conv_id", side], "left")
    return p.select("conv_id", "i", "j", F.coalesce(F.try_divide(F.col("dot"), F.col("len_i") * F.col("len_j")), F.lit(0.0)).alias("sim"))


@query(f"with {TF} select conv_id, round(1 - avg(sim), 4) as sms, round(least(1.0, greatest(0.0, avg(sim))), 4) as kpig from s group by conv_id")
def tf_cosine_light(spark, sf_dir):
    """Mean pairwise term-frequency distance and similarity of each instance."""
    return tf_pairs(turns(spark, sf_dir)).groupBy("conv_id").agg(F.round(1 - F.avg("sim"), 4).alias("sms"), F.round(scores.clamp01(F.avg("sim")), 4).alias("kpig"))


def js_profile(p, q):
    """Jensen-Shannon divergence of two ascending frequency profiles, the shorter padded with zeros at its end."""
    n = F.greatest(F.size(p), F.size(q))
    pad = lambda a: F.concat(a, F.array_repeat(F.lit(0.0), n - F.size(a)))
    eps = 1e-10
    def kl(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * F.ln((x + eps) / ((x + y) * 0.5 + eps))), F.lit(0.0), lambda s, x: s + x)
    return scores.clamp01(0.5 * kl(pad(p), pad(q)) + 0.5 * kl(pad(q), pad(p)))


@query(f"""with w as (select conv_id, turn, unnest({TOKENS.format('text')}) as word from conversations),
c as (select conv_id, turn, word, count(*)::double as n from w group by all),
f as (select conv_id, turn, list_sort(list(n / total)) as f from (select *, sum(n) over (partition by conv_id, turn) as total from c) group by conv_id, turn),
g as (select v.conv_id, v.turn, coalesce(f.f, [1e-10]::double[]) as f from conversations v left join f on v.conv_id = f.conv_id and v.turn = f.turn),
s as (select conv_id, arg_min(f, turn) as src, min(turn) as first from g group by conv_id),
z as (select g.conv_id, g.turn, list_resize(g.f, greatest(len(g.f), len(s.src)), 0.0) as p, list_resize(s.src, greatest(len(g.f), len(s.src)), 0.0) as q from g join s on g.conv_id = s.conv_id and g.turn > s.first),
n as (select conv_id, turn, list_transform(p, lambda v: v / list_sum(p)) as p, list_transform(q, lambda v: v / list_sum(q)) as q from z),
j as (select conv_id, turn, 0.5 * list_sum(list_transform(list_zip(p, q), lambda v: v[1] * ln((v[1] + 1e-10) / (0.5 * (v[1] + v[2]) + 1e-10)))) + 0.5 * list_sum(list_transform(list_zip(p, q), lambda v: v[2] * ln((v[2] + 1e-10) / (0.5 * (v[1] + v[2]) + 1e-10)))) as js from n)
select conv_id, round(avg(js), 6) as mean_js, round(case when count(*) < 2 then 0.0 else least(1.0, greatest(0.0, 20 * var_pop(least(1.0, greatest(0.0, js))))) end, 4) as trd from j group by conv_id""")
def js_profile_light(spark, sf_dir):
    """Topic drift as the variance of profile divergence between each later turn and the first."""
    t = turns(spark, sf_dir)
    c = t.select("conv_id", "turn", F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("conv_id", "turn", "word").agg(F.count(F.lit(1)).cast("double").alias("n"))
    f = c.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("n")).alias("ns"))
    total = F.aggregate("ns", F.lit(0.0), lambda s, x: s + x)
    f = f.withColumn("total", total).withColumn("f", F.transform("ns", lambda x: x / F.col("total")))
    g = t.select("conv_id", "turn").join(f, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("f", F.array(F.lit(1.0))).alias("f"))
    source = g.groupBy("conv_id").agg(F.min_by("f", "turn").alias("src"), F.min("turn").alias("first"))
    j = g.join(source, "conv_id").where("turn > first").withColumn("js", js_profile(F.col("f"), F.col("src")))
    return j.groupBy("conv_id").agg(F.round(F.avg("js"), 6).alias("mean_js"), F.round(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(scores.clamp01(20 * F.var_pop("js"))), 4).alias("trd"))


@query(f"""with t as (select conv_id, len({WORDS.format('text')})::double as n from conversations)
select conv_id, round(case when count(*) < 2 or avg(n) = 0 then 0.0 else least(1.0, var_pop(n) / (avg(n) * avg(n))) end, 6) as trd from t group by conv_id""")
def length_drift(spark, sf_dir):
    """Squared coefficient of variation of word counts."""
    t = turns(spark, sf_dir).select("conv_id", text.word_count(F.col("text")).cast("double").alias("n"))
    agg = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k"), F.avg("n").alias("m"), F.var_pop("n").alias("v"))
    return agg.select("conv_id", F.round(F.when((F.col("k") < 2) | (F.col("m") == 0), 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(F.col("v"), F.col("m") * F.col("m")))), 6).alias("trd"))


@query(f"""with w as (select conv_id, turn, role, list_distinct(list_filter({TOKENS.format('text')}, lambda w: length(w) >= 4)) as w from conversations),
g as (select conv_id, list_distinct(flatten(list(w))) as ground from w where role = 'user' group by conv_id),
r as (select w.conv_id, len(list_filter(w.w, lambda x: x not in ({COMMON})))::double as facts, len(list_filter(w.w, lambda x: x not in ({COMMON}) and not list_contains(g.ground, x)))::double as novel, len(g.ground) as n from w join g on w.conv_id = g.conv_id and role = 'assistant')
select conv_id, round(avg(case when n = 0 or facts = 0 then 0.0 else novel / facts end), 6) as hs from r group by conv_id""")
def hallucination_share(spark, sf_dir):
    """Share of an assistant's long, uncommon words that no user turn of the conversation holds."""
    t = turns(spark, sf_dir).withColumn("w", text.long_words(F.col("text")))
    ground = t.where("role = 'user'").groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("ground"))
    r = t.where("role = 'assistant'").join(ground, "conv_id").withColumn("facts", F.array_except("w", F.array(*[F.lit(w) for w in fixed.COMMON_WORDS])))
    share = F.try_divide(F.size(F.array_except("facts", "ground")).cast("double"), F.size("facts").cast("double"))
    return r.groupBy("conv_id").agg(F.round(F.avg(F.when((F.size("ground") == 0) | (F.size("facts") == 0), 0.0).otherwise(share)), 6).alias("hs"))


@query(f"""with {EXCHANGES},
q as (select conv_id, pos, len({WORDS.format('question')}) as q_words, len({WORDS.format('answer')}) as a_words,
 length(regexp_replace(question, '[^\\x00-\\x7F]', '', 'g'))::double / greatest(length(question), 1) as q_ascii, length(regexp_replace(answer, '[^\\x00-\\x7F]', '', 'g'))::double / greatest(length(answer), 1) as a_ascii from x)
select conv_id, pos, q_words, a_words from q where q_words between 5 and 60 and a_words >= 10 and q_ascii > 0.9 and a_ascii > 0.9""")
def qa_quality_filter(spark, sf_dir):
    """Question-answer pairs of the right lengths and mostly ASCII."""
    x = exchanges(spark, sf_dir).withColumn("q_words", text.word_count(F.col("question")).cast("long")).withColumn("a_words", text.word_count(F.col("answer")).cast("long"))
    good = F.col("q_words").between(5, 60) & (F.col("a_words") >= 10) & (text.ascii_ratio(F.col("question")) > 0.9) & (text.ascii_ratio(F.col("answer")) > 0.9)
    return x.where(good).select("conv_id", F.col("pos").cast("long").alias("pos"), "q_words", "a_words")


@query("""with t as (select conv_id, turn, role, trim(text) as x from conversations where trim(coalesce(text, '')) <> ''),
l as (select conv_id, arg_max(role, turn) as last_role, count(*) as n_turns, string_agg(x, chr(10) order by turn) as dialogue from t group by conv_id)
select conv_id, last_role, n_turns, md5(dialogue) as dialogue_md5, length(dialogue)::bigint as n_chars from l where length(dialogue) > 0""")
def dialogue_assembly(spark, sf_dir):
    """Non-blank turns in order, joined by line ends."""
    t = turns(spark, sf_dir).withColumn("x", F.trim("text")).where("x <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda s: s["x"]), "\n")
    out = t.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.count(F.lit(1)).alias("n_turns"), joined.alias("dialogue"))
    return out.where(F.length("dialogue") > 0).select("conv_id", "last_role", "n_turns", F.md5("dialogue").alias("dialogue_md5"), F.length("dialogue").cast("long").alias("n_chars"))


@query("""with b as (select conv_id, arg_max(text, (length(text), -turn)) as longest, arg_max(turn, (length(text), -turn)) as turn from conversations where text is not null group by conv_id) select conv_id, turn, length(longest)::bigint as n_chars from b""")
def longest_sample(spark, sf_dir):
    """The longest of a group's responses, the first of equals."""
    t = turns(spark, sf_dir).where("text is not null")
    return t.groupBy("conv_id").agg(F.max_by(F.struct("turn", F.length("text").cast("long").alias("n_chars")), F.struct(F.length("text"), -F.col("turn"))).alias("best")).select("conv_id", "best.turn", "best.n_chars")


@query(f"""with {EXCHANGES},
s as (select conv_id, pos, regexp_extract(answer, '([0-9])', 1) as d, lower(answer) as low from x where trim(coalesce(answer, '')) <> '')
select conv_id, round(avg(case when d <> '' then d::double / 5 else 0.5 end), 6) as human_score,
 round(avg(case when contains(low, 'entailment') then 1.0 when contains(low, 'neutral') then 0.5 when contains(low, 'contradiction') then 0.0 else 0.5 end), 6) as faithfulness from s group by conv_id""")
def judge_scores(spark, sf_dir):
    """Scores parsed from judges' raw outputs; blank ones don't count."""
    x = exchanges(spark, sf_dir).where(F.trim(F.coalesce("answer", F.lit(""))) != "")
    return x.groupBy("conv_id").agg(F.round(F.avg(text.judge_score(F.col("answer"))), 6).alias("human_score"), F.round(F.avg(text.entailment_score(F.col("answer"))), 6).alias("faithfulness"))


NORMAL = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


@query(f"""with {EXCHANGES} select conv_id, pos, cast({NORMAL.format('question')} = {NORMAL.format('answer')} as integer) as exact_match from x""")
def exact_match(spark, sf_dir):
    """F22."""
    return exchanges(spark, sf_dir).select("conv_id", F.col("pos").cast("long").alias("pos"), text.exact_match(F.col("question"), F.col("answer")).alias("exact_match"))


@query("""with t as (select conv_id, turn, role, md5(lower(trim(text))) as norm from conversations where text is not null),
c as (select role, norm, count(*) as n, min(row(conv_id, turn)) as first from t group by role, norm),
r as (select role, norm, n, first, row_number() over (partition by role order by n desc, first) as k from c)
select role, norm as answer_md5, n as votes from r where k = 1""")
def majority_vote(spark, sf_dir):
    """A10: the most common normalised answer, the first met of equals."""
    t = turns(spark, sf_dir).where("text is not null").withColumn("norm", F.md5(F.lower(F.trim("text"))))
    c = t.groupBy("role", "norm").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("conv_id", "turn")).alias("first"))
    return c.groupBy("role").agg(F.max_by(F.struct("norm", "n"), F.struct("n", -F.col("first.conv_id"), -F.col("first.turn"))).alias("best")).select("role", F.col("best.norm").alias("answer_md5"), F.col("best.n").alias("votes"))


# Gates take a candidate (a later turn) against its base (the first turn).
@query(f"""with b as (select conv_id, arg_min(text, turn) as base, min(turn) as t0 from conversations group by conv_id),
c as (select v.conv_id, v.turn, v.role, v.text, b.base, list_distinct({TOKENS.format('v.text')}) as w, list_distinct({TOKENS.format('b.base')}) as wb from conversations v join b on v.conv_id = b.conv_id and v.turn > b.t0),
g as (select *, len({WORDS.format('text')}) >= 5 as long_enough, lower(trim(text)) <> lower(trim(base)) as not_copy,
 case when len(w) = 0 or len(wb) = 0 then 0.0 else len(list_intersect(w, wb))::double / len(list_distinct(w || wb)) end as overlap,
 array_to_string({WORDS.format('lower(text)')}[1:8], ' ') as sig from c),
d as (select *, row_number() over (partition by conv_id, sig order by turn) = 1 as first_seen, row_number() over (partition by conv_id, role order by turn) as nth from g)
select conv_id, turn, long_enough, not_copy, first_seen, round(overlap, 6) as overlap, overlap <= 0.85 as low_overlap, nth <= 2 as under_cap, long_enough and not_copy and first_seen and overlap <= 0.85 and nth <= 2 as accepted from d""")
def candidate_gates(spark, sf_dir):
    """Independent gates of candidates: length, copy, signature, overlap with the base, cap per strategy."""
    t = turns(spark, sf_dir)
    base = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("base"), F.min("turn").alias("t0"))
    c = t.join(base, "conv_id").where("turn > t0").withColumn("sig", text.signature(F.col("text")))
    c = c.withColumn("overlap", text.jaccard(F.array_distinct(text.tokens(F.col("text"))), F.array_distinct(text.tokens(F.col("base")))))
    first = F.row_number().over(Window.partitionBy("conv_id", "sig").orderBy("turn")) == 1
    cap = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) <= fixed.PER_STRATEGY
    c = c.select("conv_id", "turn", (text.word_count(F.col("text")) >= fixed.LEAST_WORDS).alias("long_enough"), (F.lower(F.trim("text")) != F.lower(F.trim("base"))).alias("not_copy"), first.alias("first_seen"), F.round("overlap", 6).alias("overlap"), (F.col("overlap") <= fixed.OVERLAP_MOST).alias("low_overlap"), cap.alias("under_cap"))
    return c.withColumn("accepted", F.col("long_enough") & F.col("not_copy") & F.col("first_seen") & F.col("low_overlap") & F.col("under_cap"))


@query(f"""with b as (select conv_id, arg_min(text, turn) as base, min(turn) as t0, count(*) as k from conversations group by conv_id),
v as (select c.conv_id, c.turn, c.text, b.base, len({WORDS.format('c.text')}) as n, len({WORDS.format('b.base')}) as nb from conversations c join b on c.conv_id = b.conv_id and c.turn > b.t0),
f as (select conv_id, null::bigint as turn, 'Q01' as check_id, 'warning' as severity from b where k - 1 <> 4
 union all select conv_id, turn, 'Q04', 'warning' from v where n < 5 or n > 3 * nb
 union all select conv_id, turn, 'Q05', 'warning' from v where trim(text) = trim(base)
 union all select conv_id, turn, 'Q06', 'warning' from v where not contains('Reply: ' || text, text) or (contains('Reply: ' || text, base) and trim(text) <> trim(base))
 union all select conv_id, null, 'Q07', 'warning' from b where trim(coalesce(base, '')) = '')
select * from f""")
def quality_findings(spark, sf_dir):
    """Q04, Q05: findings of the variants of each conversation against its first turn; prompts and references as stored are checked in validation_findings."""
    t = turns(spark, sf_dir)
    base = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("base"), F.min("turn").alias("t0"), F.count(F.lit(1)).alias("k"))
    v = t.join(base, "conv_id").where("turn > t0").withColumn("n", text.word_count(F.col("text"))).withColumn("nb", text.word_count(F.col("base"))).withColumn("prompt", F.concat(F.lit("Reply: "), "text"))
    checks = F.array_compact(
        F.array(
            F.when((F.col("n") < fixed.LEAST_WORDS) | (F.col("n") > 3 * F.col("nb")), "Q04"),
            F.when(F.trim("text") == F.trim("base"), "Q05"),
            F.when(~F.col("prompt").contains(F.col("text")) | (F.col("prompt").contains(F.col("base")) & (F.trim("text") != F.trim("base"))), "Q06"),
        )
    )
    found = v.select("conv_id", "turn", F.explode(checks).alias("check_id"), F.lit("warning").alias("severity"))
    whole = F.array_compact(F.array(F.when(F.col("k") - 1 != 4, F.struct(F.lit("Q01").alias("c"), F.lit("warning").alias("s"))), F.when(F.trim(F.coalesce("base", F.lit(""))) == "", F.struct(F.lit("Q07").alias("c"), F.lit("warning").alias("s")))))
    more = base.select("conv_id", F.lit(None).cast("long").alias("turn"), F.explode(whole).alias("x")).select("conv_id", "turn", F.col("x.c").alias("check_id"), F.col("x.s").alias("severity"))
    return found.unionByName(more)


@query(f"""with b as (select conv_id, arg_min(text, turn) as base, min(turn) as t0, count(*) as k from conversations group by conv_id),
v as (select c.conv_id, c.turn, c.text, b.base, len({WORDS.format('c.text')}) as n, len({WORDS.format('b.base')}) as nb from conversations c join b on c.conv_id = b.conv_id and c.turn > b.t0),
f as (select 'Q01' as check_id, 'warning' as severity from b where k - 1 <> 4 union all select 'Q04', 'warning' from v where n < 5 or n > 3 * nb union all select 'Q05', 'warning' from v where trim(text) = trim(base)
 union all select 'Q06', 'warning' from v where contains('Reply: ' || text, base) and trim(text) <> trim(base) union all select 'Q07', 'warning' from b where trim(coalesce(base, '')) = '')
select check_id, severity, count(*) as n, severity <> 'error' as passed from f group by all""")
def quality_report(spark, sf_dir):
    """Q08: findings by check; errors fail."""
    return quality_findings(spark, sf_dir).groupBy("check_id", "severity").agg(F.count(F.lit(1)).alias("n")).withColumn("passed", F.col("severity") != "error")


#: Messages that a report lists of each check; all are counted.
MESSAGES = 50


@query(f"""with b as (select conv_id, arg_min(text, turn) as base, min(turn) as t0 from conversations group by conv_id),
v as (select c.conv_id, c.turn, len({WORDS.format('c.text')}) as n, len({WORDS.format('b.base')}) as nb, trim(c.text) = trim(b.base) as copy from conversations c join b on c.conv_id = b.conv_id and c.turn > b.t0),
f as (select conv_id, turn, 'Q04' as check_id from v where n < 5 or n > 3 * nb union all select conv_id, turn, 'Q05' from v where copy),
r as (select *, row_number() over (partition by check_id order by conv_id, turn) as nth, count(*) over (partition by check_id) as total from f)
select check_id, nth::integer as nth, conv_id, turn, total from r where nth <= 50""")
def report_messages(spark, sf_dir):
    """The first fifty messages of each check on variants, with the number of all."""
    f = quality_findings(spark, sf_dir).where(F.col("check_id").isin("Q04", "Q05"))
    total = f.groupBy("check_id").agg(F.count(F.lit(1)).alias("total"))
    first = f.withColumn("nth", F.row_number().over(Window.partitionBy("check_id").orderBy("conv_id", "turn"))).where(F.col("nth") <= MESSAGES)  # limited per task first
    return first.join(total, "check_id").select("check_id", "nth", "conv_id", "turn", "total")


@query(f"""with {EXCHANGES},
e as (select conv_id, pos, list_distinct(list_filter(regexp_extract_all(question, '([\\p{{L}}\\p{{N}}_]+)', 1), lambda w: regexp_matches(w, '^[A-Z][A-Za-z0-9]+$'))) as er, list_distinct(list_filter(regexp_extract_all(answer, '([\\p{{L}}\\p{{N}}_]+)', 1), lambda w: regexp_matches(w, '^[A-Z][A-Za-z0-9]+$'))) as ea, len({WORDS.format('question')})::double as nr, len({WORDS.format('answer')})::double as na from x),
s as (select *, case when len(er) = 0 then 1.0 else len(list_intersect(er, ea))::double / len(er) end as coverage, case when nr = 0 then 1.0 when na = 0 then 0.0 when na / nr < 0.5 then na / nr / 0.5 when na / nr <= 2 then 1.0 else greatest(0.0, 1 - (na / nr - 2) / 2) end as adequacy from e),
c as (select *, least(1.0, 0.2 * adequacy + 0.4 * coverage) * case when coverage < 0.2 then 0.6 else 1.0 end as cs from s)
select conv_id, pos, round(coverage, 6) as coverage, round(adequacy, 6) as adequacy, round(cs, 6) as cs, case when cs < 0.25 then 'irrelevant' else 'ok' end as flag from c""")
def entity_coverage(spark, sf_dir):
    """C06 without embeddings, M06, F05, P20: correctness of an answer from entity coverage and length adequacy."""
    x = exchanges(spark, sf_dir).withColumn("er", text.entities(F.col("question"))).withColumn("ea", text.entities(F.col("answer")))
    x = x.withColumn("coverage", F.when(F.size("er") == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect("er", "ea")).cast("double"), F.size("er").cast("double"))))
    x = x.withColumn("adequacy", scores.length_adequacy(text.word_count(F.col("answer")), text.word_count(F.col("question"))))
    x = x.withColumn("cs", F.least(F.lit(1.0), 0.2 * F.col("adequacy") + 0.4 * F.col("coverage")) * F.when(F.col("coverage") < 0.2, 0.6).otherwise(1.0))
    return x.select("conv_id", F.col("pos").cast("long").alias("pos"), F.round("coverage", 6).alias("coverage"), F.round("adequacy", 6).alias("adequacy"), F.round("cs", 6).alias("cs"), F.when(F.col("cs") < 0.25, "irrelevant").otherwise("ok").alias("flag"))


@query("""select conv_id, min(turn) = 0 and max(turn) = count(*) - 1 and count(distinct turn) = count(*) as contiguous from conversations group by conv_id""")
def contiguity(spark, sf_dir):
    """Turns are 0 to n - 1."""
    g = turns(spark, sf_dir).groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.count(F.lit(1)).alias("n"), F.count_distinct("turn").alias("d"))
    return g.select("conv_id", ((F.col("a") == 0) & (F.col("b") == F.col("n") - 1) & (F.col("d") == F.col("n"))).alias("contiguous"))


@query("""with l as (select conv_id, list(md5(text) order by turn) as t from conversations group by conv_id), p as (select conv_id, t || list_transform(range(greatest(0, 10 - len(t))), lambda i: t[len(t)]) as t from l)
select conv_id, unnest(range(0, len(t))) as slot, unnest(t) as text_md5 from p""")
def padded_variants(spark, sf_dir):
    """Groups of fewer than ten members padded to ten with their last one; larger ones as they are."""
    t = turns(spark, sf_dir).select("conv_id", "turn", F.md5("text").alias("text_md5"))
    own = t.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("slot"), "text_md5")
    last = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("text_md5", "turn").alias("text_md5")).where("n < 10")
    return own.unionByName(last.select("conv_id", F.explode(F.sequence(F.col("n"), F.lit(9).cast("long"))).alias("slot"), "text_md5"))


@query("""select conv_id, max(case when turn = 0 then md5(text) end) as v0, max(case when turn = 1 then md5(text) end) as v1, max(case when turn = 2 then md5(text) end) as v2, max(case when turn = 3 then md5(text) end) as v3, max(case when turn = 4 then md5(text) end) as v4,
 sum(case when turn >= 5 then ('0x' || substr(md5(turn || ':' || text), 1, 8))::bigint end)::bigint as rest, count(*) filter (turn >= 5) as n_rest, round(avg(length(text)), 6) as avg_length from conversations group by conv_id""")
def wide_variants(spark, sf_dir):
    """The first five variants as columns, number and checksum of the further ones, and an average over all."""
    t, k = turns(spark, sf_dir), F.col("turn")
    check = F.conv(F.substring(F.md5(F.concat(k.cast("string"), F.lit(":"), "text")), 1, 8), 16, 10).cast("long")
    columns = [F.max(F.when(k == i, F.md5("text"))).alias(f"v{i}") for i in range(5)]
    return t.groupBy("conv_id").agg(*columns, F.sum(F.when(k >= 5, check)).alias("rest"), F.count(F.when(k >= 5, 1)).alias("n_rest"), F.round(F.avg(F.length("text")), 6).alias("avg_length"))


@query(f"""with {EXCHANGES}, p as (select conv_id, pos, question as premise, answer as hypothesis, 'fwd' as d from x union all select conv_id, pos, answer, question, 'rev' from x),
s as (select conv_id, pos, d, case when len(h) = 0 then 0.0 else len(list_intersect(h, q))::double / len(h) end as entail from (select *, list_distinct({TOKENS.format('hypothesis')}) as h, list_distinct({TOKENS.format('premise')}) as q from p)),
w as (select conv_id, pos, max(case when d = 'fwd' then entail end) as fwd, max(case when d = 'rev' then entail end) as rev from s group by all)
select conv_id, pos, round(fwd, 6) as entail_fwd, round(rev, 6) as entail_rev, case when fwd > 0.5 and rev > 0.5 then 'bidirectional' when fwd > 0.5 or rev > 0.5 then 'one_direction' else 'neither' end as verdict from w""")
def entailment_audit(spark, sf_dir):
    """Both directions scored, pivoted, judged; token inclusion stands in for a model's probability."""
    x = exchanges(spark, sf_dir)
    both = x.select("conv_id", "pos", F.col("question").alias("premise"), F.col("answer").alias("hypothesis"), F.lit("fwd").alias("d")).unionByName(x.select("conv_id", "pos", F.col("answer").alias("premise"), F.col("question").alias("hypothesis"), F.lit("rev").alias("d")))
    both = both.withColumn("h", F.array_distinct(text.tokens(F.col("hypothesis")))).withColumn("q", F.array_distinct(text.tokens(F.col("premise"))))
    both = both.withColumn("entail", F.coalesce(F.try_divide(F.size(F.array_intersect("h", "q")).cast("double"), F.size("h").cast("double")), F.lit(0.0)))
    w = both.groupBy("conv_id", "pos").pivot("d", ["fwd", "rev"]).agg(F.max("entail"))
    verdict = F.when((F.col("fwd") > 0.5) & (F.col("rev") > 0.5), "bidirectional").when((F.col("fwd") > 0.5) | (F.col("rev") > 0.5), "one_direction").otherwise("neither")
    return w.select("conv_id", F.col("pos").cast("long").alias("pos"), F.round("fwd", 6).alias("entail_fwd"), F.round("rev", 6).alias("entail_rev"), verdict.alias("verdict"))
