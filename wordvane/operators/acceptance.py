"""Greedy acceptance of candidates: inherently one after another within an instance, so instances are what is parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordvane.functions import fixed
from wordvane.functions.text import jaccard, signature, tokens, word_count


def greedy_accept(candidates: DataFrame, most: int = 4, overlap: float = fixed.OVERLAP_MOST, per_strategy: int = fixed.PER_STRATEGY, key: str = "instance") -> DataFrame:
    """instance, attempt, strategy, variant_idx of the accepted candidates. candidates: instance, attempt, strategy, base, text.

    In order of attempt a candidate is taken unless `most` are, its strategy has its cap, it is short, a copy of the base, has a
    signature seen among the accepted, or overlaps the base or an accepted one too much. What a candidate fails by itself is left out
    before the groups are made; the rest is one fold over an instance's candidates in order, whose state holds the accepted ones only.
    With a key that is the same for several instances they share this state: a pool of candidates that is filtered as one.
    """
    ready = candidates.select(
        key, "attempt", "strategy", F.array_distinct(tokens(F.col("text"))).alias("words"), F.array_distinct(tokens(F.col("base"))).alias("base_words"),
        signature(F.col("text")).alias("sig"), word_count(F.col("text")).alias("n"), (F.lower(F.trim("text")) == F.lower(F.trim("base"))).alias("copy"),
    )
    ready = ready.where((F.col("n") >= fixed.LEAST_WORDS) & ~F.col("copy") & (jaccard(F.col("words"), F.col("base_words")) <= overlap))
    row = F.struct("attempt", "strategy", "sig", "words")
    kind = "array<struct<attempt:bigint,strategy:string,sig:string,words:array<string>>>"

    def step(taken: Column, x: Column) -> Column:
        same = F.size(F.filter(taken, lambda t: t["strategy"].eqNullSafe(x["strategy"])))
        met = F.exists(taken, lambda t: (t["sig"] == x["sig"]) | (jaccard(t["words"], x["words"]) > overlap))
        return F.when((F.size(taken) < most) & (same < per_strategy) & ~met, F.concat(taken, F.array(x))).otherwise(taken)

    grouped = ready.groupBy(key).agg(F.array_sort(F.collect_list(row)).cast(kind).alias("rows"))
    taken = grouped.select(key, F.posexplode(F.aggregate("rows", F.array().cast(kind), step)).alias("variant_idx", "r"))
    return taken.select(key, F.col("r.attempt").alias("attempt"), F.col("r.strategy").alias("strategy"), "variant_idx")


def pool_filter(candidates: DataFrame, canonical: str, per_level: int) -> DataFrame:
    """level, nth, id, similarity: the pool of instructions that candidates (level, attempt, pos, id, text, similarity) make, all levels sharing what has been met.

    A candidate must have the least number of words, a similarity within bounds, and no more than so much of its words in common with the canonical
    instruction. Of those with the same first words, in any level, the first by level, attempt and place counts, and none that begins like the canonical one. Each
    level takes its first per_level of these; those beyond still count as met. Signatures are grouped with partial results, so no task gets the pool.
    """
    near = F.col("similarity").between(*fixed.POOL_SIMILARITY)
    unlike = jaccard(F.array_distinct(tokens(F.col("text"))), F.array_distinct(tokens(F.lit(canonical)))) <= fixed.POOL_OVERLAP
    ready = candidates.where((word_count(F.col("text")) >= fixed.POOL_WORDS) & near & unlike).select("level", "attempt", "pos", "id", "similarity", signature(F.col("text")).alias("sig"))
    ready = ready.where(F.col("sig") != signature(F.lit(canonical)))
    first = ready.groupBy("sig").agg(F.min(F.struct("level", "attempt", "pos", "id", "similarity")).alias("c")).select("c.*")
    nth = F.row_number().over(Window.partitionBy("level").orderBy("attempt", "pos", "id"))
    return first.withColumn("nth", nth).where(F.col("nth") <= per_level).select("level", "nth", "id", "similarity")


def centroid_response(responses: DataFrame) -> DataFrame:
    """instance, idx, mean: of each instance's responses (instance, idx, text) the one whose mean ROUGE-L with the others is greatest, the first of equals. A blank
    response, and a single one, has the mean 0. Pairs are made in tiles."""
    from wordvane.functions.overlap import rouge_l_score
    from wordvane.plans.dialogue import pairs_within

    pairs = pairs_within(responses, "instance", "idx", "text").select("instance", "i", "j", rouge_l_score(F.col("text_i"), F.col("text_j")).alias("s"))
    both = pairs.select("instance", F.explode(F.array("i", "j")).alias("idx"), "s").groupBy("instance", "idx").agg(F.avg("s").alias("mean"))
    each = responses.select("instance", "idx", F.col("text").rlike(r"\S").alias("some")).join(both, ["instance", "idx"], "left")
    each = each.withColumn("mean", F.when(F.col("some"), F.coalesce("mean", F.lit(0.0))).otherwise(0.0))
    best = F.min(F.struct((-F.col("mean")).alias("less"), F.col("idx"))).alias("b")
    return each.groupBy("instance").agg(best).select("instance", F.col("b.idx").alias("idx"), (-F.col("b.less")).alias("mean"))
