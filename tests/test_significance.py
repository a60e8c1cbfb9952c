"""p-values in the plan against plain versions on the driver; alignment, records without a test, correlation reports."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from wordvane.operators import significance, stats


def test_exact_distribution(spark):
    """Against every sign pattern of up to ten ranks."""
    rows = [(n, w) for n in range(2, 11) for w in range(n * (n + 1) // 2 + 1)]
    c = F.col
    found = spark.createDataFrame(rows, "n long, w long").withColumn("w", c("w").cast("double")).select("n", "w", significance.signed_rank_p(c("w"), c("n"), F.lit(0), True).alias("one"), significance.signed_rank_p(c("w"), c("n"), F.lit(0), False).alias("two")).collect()
    sums = {n: [sum(k for k, s in enumerate(signs, 1) if s) for signs in itertools.product((0, 1), repeat=n)] for n in range(2, 11)}
    for r in found:
        up, down = sum(s >= r.w for s in sums[r.n]) / 2**r.n, sum(s <= r.w for s in sums[r.n]) / 2**r.n
        assert r.one == pytest.approx(up) and r.two == pytest.approx(min(1.0, 2 * min(up, down)))


def test_tails_and_correlations(spark):
    zs = [k / 7 for k in range(-60, 61)] + [12.0, 30.0, 60.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", significance.normal_tail(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=1e-9, abs=1e-300) for r in got)
    rows = [(r / 20, n) for r in range(-20, 21) for n in (2, 3, 4, 10, 57, 1000, 200_000)] + [(0.004, 1_000_000)]
    got = spark.createDataFrame(rows, "r double, n long").select("r", "n", significance.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert all(x.p == pytest.approx(stats.correlation_p(x.r, x.n), rel=1e-6, abs=1e-12) for x in got)
    a, b, x = F.lit(2.5), F.lit(1.5), F.col("x")
    got = spark.createDataFrame([(k / 10,) for k in range(-1, 12)], "x double").select("x", significance.incomplete_beta(a, b, x).alias("p")).collect()
    assert all(r.p == pytest.approx(stats.beta_inc(2.5, 1.5, r.x), abs=1e-12) for r in got)


def plain_test(ds, greater):
    ds = [d for d in ds if d is not None and not math.isnan(d) and d != 0]
    if len(ds) < 2:
        return None
    values = sorted(abs(d) for d in ds)
    rank = {a: sum(i for i, v in enumerate(values, 1) if v == a) / values.count(a) for a in set(values)}
    w = sum(rank[abs(d)] for d in ds if d > 0)
    ties = tuple(values.count(a) for a in set(values) if values.count(a) > 1)
    n = len(ds)
    return w if greater else min(w, n * (n + 1) / 2 - w), stats.wilcoxon_p(w, n, greater, ties)


@pytest.mark.parametrize("greater", [True, False])
def test_signed_rank_tests(spark, greater):
    groups = {"exact": [k * (-1) ** (k % 3) / 10 for k in range(1, 31)], "ties": [1.0, -1.0, 2.0, 2.0, -3.0, 0.0, 5.0], "large": [math.sin(k) + 0.2 for k in range(80)], "fifty": [k if k % 4 else -k for k in range(1, 51)], "one": [0.5, 0.0, float("nan"), None], "none": [0.0, 0.0]}
    rows = [(k, d if d is None else float(d)) for k, ds in groups.items() for d in ds]
    got = {r.key: r for r in significance.signed_rank_tests(spark.createDataFrame(rows, "key string, d double"), "key", "d", greater, alpha=0.05).collect()}
    for k, ds in groups.items():
        want = plain_test([d if d is None else float(d) for d in ds], greater)
        if want is None:
            assert (got[k].statistic, got[k].p_value, got[k].significant, got[k].note) == (None, None, False, significance.TOO_FEW)
        else:
            assert got[k].statistic == pytest.approx(want[0]) and got[k].p_value == pytest.approx(want[1], rel=1e-9) and got[k].significant == (want[1] < 0.05) and got[k].note is None


def test_evaluation_aligns(spark):
    base = [("e", k, 0, 9.0, 9.0) for k in range(5)] + [("e", k, 1, 0.5 + k / 100, 0.2 + k / 50) for k in range(5)] + [("f", 1, 0, 0.5, 0.0)]
    after = [("e", k, 3, 0.5 + k / 90 if k != 2 else None, 0.4, 0.1, k) for k in range(4)] + [("e", 4, 0, None, None, 0.1, 7), ("e", 9, 0, 0.1, None, 0.1, 1), ("f", 1, 0, None, 0.5, 0.0, 2)]
    frames = spark.createDataFrame(base, "g string, item long, run long, rouge_mean double, rouge_var double"), spark.createDataFrame(after, "g string, item long, run long, treated_mean double, treated_single double, treated_var double, layer long")
    got = {r.g: r for r in significance.evaluation(*frames, "g", "item", "run").collect()}
    e, f = got["e"], got["f"]
    assert e.n_items == 4 and e.baseline_rouge == pytest.approx(sum(0.5 + k / 100 for k in range(4)) / 4)  # the last run, and no item without a score
    assert e.treated_rouge == pytest.approx((0.5 + 0.4 + 1.0 + 1 / 90 + 3 / 90) / 4) and e.var_p_value == pytest.approx(1 / 16) and not e.var_significant
    assert (f.n_items, f.var_note, f.var_dz, f.var_reduction, f.variance_eliminated, f.quality_preserved, f.layer_cv) == (1, significance.TOO_FEW, None, 0.0, True, True, 0.0)


def test_correlation_report(spark):
    rows = [("a", "PRI", float(k), float(k * k)) for k in range(6)] + [("a", "flat", 1.0, float(k)) for k in range(6)] + [("a", "zero", 0.0, float(k)) for k in range(6)] + [("b", "PRI", 1.0, 2.0)]
    got = {(r.k, r.m): r for r in significance.correlation_report(spark.createDataFrame(rows, "k string, m string, x double, y double"), "k", "m", "x", "y", ("PRI",)).collect()}
    assert set(got) == {("a", "PRI"), ("a", "flat"), ("b", None)}
    assert got["a", "PRI"].spearman_rho == pytest.approx(1.0) and got["a", "PRI"].spearman_p == pytest.approx(0.0, abs=1e-6) and got["a", "PRI"].pearson_p == pytest.approx(stats.correlation_p(got["a", "PRI"].pearson_r, 6))
    assert (got["a", "flat"].pearson_r, got["a", "flat"].pearson_p) == (0.0, 1.0) and got["b", None].status == "insufficient_data"


def test_exact_percentiles(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=1001), "b": rng.integers(0, 5, 400).astype(float), "c": np.array([2.0]), "d": np.array([1.0, 2.0])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("e", None)]
    shares = {"p0": 0.0, "p25": 0.25, "mid": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.k: r for r in stats.exact_percentiles(spark.createDataFrame(rows, "k string, x double"), "k", "x", shares).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert [got[k][n] for n in shares] == pytest.approx([np.quantile(v, p) for p in shares.values()])


def test_pairs_of_a_huge_group(spark):
    """Every pair once, in order; the pairs of one huge group are dealt to many keys of like size."""
    from wordvane.plans.dialogue import pairs_within

    rows = spark.range(300).select(F.when(F.col("id") < 260, 1).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("t"), F.col("id").cast("string").alias("x"))
    for tile in (256, 20):
        got = sorted(map(tuple, pairs_within(rows, "k", "t", "x", tile=tile).collect()))
        members = {}
        for r in rows.collect():
            members.setdefault(r.k, []).append(r.t)
        assert got == sorted((k, i, j, str(i), str(j)) for k, ts in members.items() for i in ts for j in ts if i < j)
    many = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    blocks = many.groupBy(F.pmod(F.xxhash64("t"), F.lit(79)).alias("b")).count().select("count").collect()
    assert max(r["count"] for r in blocks) ** 2 < 4 * (20_000 / 79) ** 2
