"""p-values as column expressions, and paired tests of many groups in one plan.

Nothing here leaves the executors: the null distribution of the signed rank sum is a fold over an array, the incomplete beta function a
continued fraction of as many steps as its parameters ask for, the normal tail a series or a fraction of fixed length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordvane.operators import stats
from wordvane.sources.stores import staged

#: Pairs up to which the exact distribution is used, where no two absolute differences are equal.
EXACT_PAIRS = 50
TOO_FEW = "Insufficient non-zero differences"
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series eight places up."""
    z = x + 8
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return series - sum((F.ln(x + k) for k in range(8)), F.lit(0.0))


def _away_from_zero(x: Column) -> Column:
    return F.when(F.abs(x) > TINY, x).otherwise(F.lit(TINY))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's method; it is settled after about as many steps as the root of a parameter.

    Its numerators are found first, and the product is taken a step late, so that no step holds the terms of another many times over.
    """
    steps = F.sequence(F.lit(1), F.greatest(F.lit(60), F.ceil(5 * F.sqrt(F.greatest(a, b)))).cast("int"))
    d0 = 1 / _away_from_zero(1 - (a + b) * x / (a + 1))
    even = lambda m: m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
    odd = lambda m: -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
    numerators = F.flatten(F.transform(steps, lambda m: F.array(even(m), odd(m))))

    def step(s: Column, numerator: Column) -> Column:
        return F.struct(_away_from_zero(1 + numerator / s["c"]).alias("c"), (1 / _away_from_zero(1 + numerator * s["d"])).alias("d"), (s["out"] * s["c"] * s["d"]).alias("out"))

    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), F.lit(1.0).alias("out"))
    return F.aggregate(numerators, start, step, lambda s: s["out"] * s["c"] * s["d"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function, for a, b > 0 and any x (0 below 0, 1 above 1)."""
    inside = F.least(F.greatest(x, F.lit(1e-15)), F.lit(1 - 1e-15))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(inside) + b * F.ln(1 - inside))
    low = inside <= (a + 1) / (a + b + 2)
    value = F.when(low, front * _beta_fraction(a, b, inside) / a).otherwise(1 - front * _beta_fraction(b, a, 1 - inside) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs, by Student's t with n - 2 degrees of freedom; 1 for fewer than three pairs."""
    half = (F.greatest(n, F.lit(3)).cast("double") - 2) / 2
    return F.when(n < 3, 1.0).when(F.abs(r) >= 1, 0.0).otherwise(incomplete_beta(half, F.lit(0.5), 1 - r * r))


def normal_tail(z: Column) -> Column:
    """Probability that a standard normal variable is above z."""
    x = F.abs(z) / math.sqrt(2)
    low = F.least(x, F.lit(2.0))
    term = lambda s, k: F.struct((s["t"] * 2 * low * low / (2 * k + 1)).alias("t"), (s["out"] + s["t"] * 2 * low * low / (2 * k + 1)).alias("out"))
    erf = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(low.alias("t"), low.alias("out")), term, lambda s: s["out"]) * F.exp(-low * low) * (2 / math.sqrt(math.pi))
    high = F.least(F.greatest(x, F.lit(2.0)), F.lit(26.0))
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), high, lambda t, k: high + k / 2 / t)
    erfc = F.when(x < 2, 1 - erf).when(x > 26, 0.0).otherwise(F.exp(-high * high) / math.sqrt(math.pi) / fraction)
    return F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)


def signed_rank_ways(n: Column) -> Column:
    """Of n signed ranks, n up to EXACT_PAIRS: in how many of 2^n ways their positive ones sum to 0, 1, 2 and so on."""
    zeros = lambda k: F.array_repeat(F.lit(0).cast("long"), k)
    grown = lambda w, k: F.zip_with(F.concat(w, zeros(k)), F.concat(zeros(k), w), lambda a, b: a + b)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n.cast("int"), F.lit(EXACT_PAIRS)))), F.array(F.lit(1).cast("long")), grown)


def signed_rank_p(w_plus: Column, n: Column, tied: Column, greater: bool) -> Column:
    """p-value of the sum of positive ranks of n differences, one-sided (they are the larger ones) or two-sided. tied: sum of t^3 - t over groups of
    equal absolute differences. Exact up to EXACT_PAIRS without ties, by the normal distribution otherwise."""
    ways = signed_rank_ways(n)
    total = F.pow(F.lit(2.0), F.least(n, F.lit(EXACT_PAIRS)).cast("double"))
    share = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + x).cast("double") / total
    upper = share(F.slice(ways, F.ceil(w_plus).cast("int") + 1, F.lit(EXACT_PAIRS * (EXACT_PAIRS + 1) // 2 + 1)))
    lower = share(F.slice(ways, F.lit(1), F.floor(w_plus).cast("int") + 1))
    d = n.cast("double")
    sd = F.sqrt(d * (d + 1) * (2 * d + 1) / 24 - tied.cast("double") / 48)
    z = F.coalesce(F.try_divide(w_plus - d * (d + 1) / 4, sd), F.lit(0.0))
    exact = upper if greater else F.least(F.lit(1.0), 2 * F.least(upper, lower))
    normal = normal_tail(z) if greater else F.least(F.lit(1.0), 2 * normal_tail(F.abs(z)))
    return F.when((n <= EXACT_PAIRS) & (tied == 0), exact).otherwise(normal)


def signed_rank_tests(pairs: DataFrame, key: str, d: str, greater: bool = True, alpha: float = 0.01) -> DataFrame:
    """key, n_used, statistic, p_value, significant, note: the signed-rank test of each key's differences d.

    Zeros, nulls and NaN are left out. With fewer than two left there is no statistic and no p, and the note says so. The statistic is the sum of
    positive ranks, or the lesser sum if two-sided. Ranks come from counts of distinct values, in slices, so no task gets all of a key.
    """
    used = pairs.where(F.col(d).isNotNull() & ~F.isnan(d) & (F.col(d) != 0)).select(key, F.abs(d).alias("_a"), (F.col(d) > 0).cast("long").alias("_plus"))
    values = used.groupBy(key, "_a").agg(F.count(F.lit(1)).alias("_t"), F.sum("_plus").alias("_plus"))
    ranked = values.join(stats.tie_ranks(used, key, "_a"), [key, "_a"])
    t = F.col("_t")
    sums = ranked.groupBy(key).agg(F.sum(t).alias("n_used"), F.sum(F.col("rank") * F.col("_plus")).alias("_w"), F.sum(t * t * t - t).alias("_tied"))
    out = pairs.select(key).distinct().join(sums, key, "left").withColumn("n_used", F.coalesce("n_used", F.lit(0)))
    n, w = F.col("n_used"), F.col("_w")
    enough = n >= 2
    statistic = w if greater else F.least(w, n * (n + 1) / 2 - w)
    p = F.when(enough, signed_rank_p(w, n, F.col("_tied"), greater))
    out = out.withColumn("p_value", p)
    return out.select(key, "n_used", F.when(enough, statistic).alias("statistic"), "p_value", F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("significant"), F.when(~enough, TOO_FEW).alias("note"))


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows of the same keys the one that comes last by order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def aligned(baseline: DataFrame, treated: DataFrame, key: str, item: str, order: str) -> DataFrame:
    """Pairs of both results, as evaluation() takes them, with the score after and the differences d_var and d_rouge."""
    c = F.col
    pairs = last_of(baseline.select(key, item, order, "rouge_mean", "rouge_var"), [key, item], order).drop(order).join(last_of(treated.select(key, item, order, "treated_mean", "treated_single", "treated_var", "layer"), [key, item], order).drop(order), [key, item])
    pairs = pairs.withColumn("after", F.coalesce("treated_mean", "treated_single")).where("treated_var is not null and after is not null")
    return pairs.withColumns({"d_var": c("rouge_var") - c("treated_var"), "d_rouge": c("rouge_mean") - c("after")})


def evaluation(baseline: DataFrame, treated: DataFrame, key: str, item: str, order: str, alpha: float = 0.01) -> DataFrame:
    """One row for each key: baseline against treated results, aligned by (key, item); of several runs the last counts.

    baseline: rouge_mean, rouge_var; treated: treated_mean, treated_single (stands in where the mean is missing), treated_var, layer. Items
    without a treated variance or score don't count; keys without any valid item get no row. Effect sizes are positive for improvement; a
    standard deviation below 1e-12 or fewer than two items give none.
    """
    c = F.col
    pairs = staged(aligned(baseline, treated, key, item, order))
    dz = lambda d, sign: F.when((F.count(d) >= 2) & (F.stddev_samp(d) >= 1e-12), sign * F.try_divide(F.avg(d), F.stddev_samp(d)))
    out = pairs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_items"), F.avg("rouge_mean").alias("baseline_rouge"), F.avg("after").alias("treated_rouge"), F.avg("rouge_var").alias("baseline_var"), F.avg("treated_var").alias("treated_var"),
        dz("d_var", 1.0).alias("var_dz"), dz("d_rouge", -1.0).alias("rouge_dz"), F.avg("layer").alias("layer_mean"), F.stddev_pop("layer").alias("layer_std"), F.min("layer").alias("layer_least"), F.max("layer").alias("layer_most"),
    )
    out = out.withColumns({
        "var_reduction": F.when(c("baseline_var") > 0, 1 - F.try_divide(c("treated_var"), c("baseline_var"))).otherwise(0.0), "rouge_change": c("treated_rouge") - c("baseline_rouge"),
        "layer_cv": F.when(c("layer_mean") > 0, F.try_divide(c("layer_std"), c("layer_mean"))).otherwise(F.when(c("layer_mean").isNotNull(), 0.0)), "variance_eliminated": c("treated_var") == 0.0,
    })
    out = out.withColumns({"rouge_change_pct": F.when(c("baseline_rouge") > 0, F.try_divide(c("rouge_change") * 100, c("baseline_rouge"))).otherwise(0.0), "quality_preserved": F.abs("rouge_change") < 2.0})
    for d, name, greater in (("d_var", "var", True), ("d_rouge", "rouge", False)):
        found = signed_rank_tests(pairs, key, d, greater, alpha)
        out = out.join(found.select(key, *[c(x).alias(f"{name}_{x}") for x in ("n_used", "statistic", "p_value", "significant", "note")]), key)
    return out


def correlation_report(long: DataFrame, key: str, metric: str, x: str, y: str, always: tuple[str, ...]) -> DataFrame:
    """key, metric, status, n, pearson_r, pearson_p, spearman_rho, spearman_p: each metric with y, rows complete in long format.

    Keys of fewer than three rows get one row of status insufficient_data. Metrics not in `always` are left out for keys where they are 0 throughout.
    A nearly constant side gives a correlation of 0 and a p of 1.
    """
    pair = F.struct(F.col(key).alias("k"), F.col(metric).alias("m")).alias("_pair")
    found = stats.wide_correlations(long.select(pair, F.col(x).alias("_x"), F.col(y).alias("_y")), "_pair", ["_x"], "_y")
    return _reported(found.select(F.col("_pair.k").alias("k"), F.col("_pair.m").alias("m"), "rows", "some", "n", "pearson", "spearman"), key, metric, always)


def wide_correlation_report(wide: DataFrame, key: str, metrics: list[str], y: str, always: tuple[str, ...]) -> DataFrame:
    """correlation_report() of rows that hold all their metrics, each in its column; the ranks of y are found once for all."""
    return _reported(stats.wide_correlations(wide, key, metrics, y).withColumnsRenamed({key: "k", "metric": "m"}), key, "metric", always)


def _reported(found: DataFrame, key: str, metric: str, always: tuple[str, ...]) -> DataFrame:
    """The report of found correlations, whose key and metric are k and m."""
    # Few rows, but a p-value takes as many steps as the root of n: they are dealt by number, not by bytes.
    found = staged(found).repartition(2 * found.sparkSession.sparkContext.defaultParallelism)
    few = found.groupBy("k").agg(F.max(F.when(F.col("rows") < 3, F.col("rows"))).alias("n")).where("n > 0")
    r = found.where((F.col("n") >= 3) & (F.col("m").isin(*always) | F.col("some")))
    p = lambda c: F.when(F.col(c) == 0.0, 1.0).otherwise(correlation_p(F.col(c), F.col("n")))
    full = r.select(F.col("k").alias(key), F.col("m").alias(metric), F.lit("complete").alias("status"), "n", F.col("pearson").alias("pearson_r"), p("pearson").alias("pearson_p"), F.col("spearman").alias("spearman_rho"), p("spearman").alias("spearman_p"))
    none = F.lit(None).cast("double")
    return full.unionByName(few.select(F.col("k").alias(key), F.lit(None).cast("string").alias(metric), F.lit("insufficient_data").alias("status"), "n", none.alias("pearson_r"), none.alias("pearson_p"), none.alias("spearman_rho"), none.alias("spearman_p")))


def evaluation_intervals(baseline: DataFrame, treated: DataFrame, key: str, item: str, order: str, resamples: int = 10_000, level: float = 0.95) -> DataFrame:
    """key, kind, n, mean, low, high: bootstrap intervals of the mean change of each key, for kind variance_reduction (before less after) and rouge_change (after less before)."""
    pairs = staged(aligned(baseline, treated, key, item, order))
    long = pairs.select(F.explode(F.array(F.struct(F.col(key).alias("k"), F.lit("variance_reduction").alias("kind"), F.col("d_var").alias("x")), F.struct(F.col(key).alias("k"), F.lit("rouge_change").alias("kind"), (-F.col("d_rouge")).alias("x")))).alias("r")).select(F.concat_ws("\x1f", "r.kind", F.col("r.k").cast("string")).alias("_both"), "r.k", "r.kind", "r.x")
    names = long.select("_both", "k", "kind").distinct()
    return stats.poisson_intervals(long, "_both", "x", resamples, level=level).join(names, "_both").select(F.col("k").alias(key), "kind", "n", "mean", "low", "high")
