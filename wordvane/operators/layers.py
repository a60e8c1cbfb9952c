"""What a model's layers say of a prompt's variants, from stored tables of single tokens.

log_probs: inst, variant, layer, pos, lp (log-probability of the token at pos that layer's read-out gives); entropies: inst, variant, pos, h.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Losses above this count as it: exp() of them would leave no number to compare.
MOST_LOSS = 20.0


def token_perplexity(log_probs: DataFrame) -> DataFrame:
    """log_probs with ppl, exp(-lp)."""
    return log_probs.withColumn("ppl", F.exp(F.least(-F.col("lp"), F.lit(MOST_LOSS))))


def scan_range(n_layers: int, start: float = 0.25, end: float = 1.0) -> tuple[int, int]:
    """The first layer scanned, and the first one after the last."""
    return int(n_layers * start), int(n_layers * end)


def sensitivity_curve(log_probs: DataFrame, n_layers: int, start: float = 0.25, end: float = 1.0) -> DataFrame:
    """inst, layer, s: sample variance over variants of each layer's mean token perplexity, in the scan range.

    Layers that some variant of the instance lacks are left out, as are all layers of an instance of one variant.
    """
    first, after = scan_range(n_layers, start, end)
    variants = log_probs.groupBy("inst").agg(F.count_distinct("variant").alias("k"))
    means = token_perplexity(log_probs).where((F.col("layer") >= first) & (F.col("layer") < after)).groupBy("inst", "variant", "layer").agg(F.avg("ppl").alias("m"))
    return means.groupBy("inst", "layer").agg(F.var_samp("m").alias("s"), F.count(F.lit(1)).alias("n")).join(variants, "inst").where("n = k and k > 1").select("inst", "layer", "s")


def chosen_layers(curve: DataFrame, instances: DataFrame, last: int, z: float = 2.0, forced: int | None = None) -> DataFrame:
    """inst, inflection, zscore: the layer of the sharpest rise of s, the first of equals; and the first with s above mean + z deviations, else of the greatest s.

    One layer is its own inflection; instances without a curve get `last`. forced: that layer for all, whatever the curve.
    """
    if forced is not None:
        return instances.select("inst", F.lit(forced).alias("inflection"), F.lit(forced).alias("zscore"))
    s = curve.withColumn("delta", F.col("s") - F.lag("s").over(Window.partitionBy("inst").orderBy("layer")))
    stats = s.groupBy("inst").agg((F.avg("s") + z * F.stddev_samp("s")).alias("threshold"))
    rise = F.max_by("layer", F.when(F.col("delta").isNotNull(), F.struct("delta", -F.col("layer"))))
    found = s.join(stats, "inst").groupBy("inst").agg(F.coalesce(rise, F.max("layer")).alias("inflection"), F.coalesce(F.min(F.when(F.col("s") > F.col("threshold"), F.col("layer"))), F.max_by("layer", F.struct("s", -F.col("layer")))).alias("zscore"))
    either = lambda c: F.coalesce(c, F.lit(last)).cast("int").alias(c)
    return instances.select("inst").join(found, "inst", "left").select("inst", either("inflection"), either("zscore"))


def branching_stability(entropies: DataFrame) -> DataFrame:
    """inst, pc_stab, min_len, mean_branching: the mean over positions of the variance over variants of exp(h), positions cut to the shortest variant."""
    b = entropies.select("inst", "variant", "pos", F.exp("h").alias("b"))
    lengths = b.groupBy("inst", "variant").agg((F.max("pos") + 1).alias("len"), F.avg("b").alias("mean"))
    shortest = lengths.groupBy("inst").agg(F.min("len").alias("min_len"), F.avg("mean").alias("mean_branching"))
    each = b.join(shortest, "inst").where("pos < min_len").groupBy("inst", "pos").agg(F.var_samp("b").alias("v"))
    return each.groupBy("inst").agg(F.avg("v").alias("pc_stab")).join(shortest, "inst")


def sequence_perplexity(log_probs: DataFrame, n_layers: int) -> DataFrame:
    """inst, ppl_var, ppl_mean: deviation and mean over variants of exp of the mean loss at the last layer."""
    seq = log_probs.where(F.col("layer") == n_layers - 1).groupBy("inst", "variant").agg(F.exp(F.least(F.avg(-F.col("lp")), F.lit(MOST_LOSS))).alias("ppl"))
    return seq.groupBy("inst").agg(F.stddev_samp("ppl").alias("ppl_var"), F.avg("ppl").alias("ppl_mean"))
