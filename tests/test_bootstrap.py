"""The registered bootstrap: enough resamples that its bounds are those of the data, not of chance."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry
from wordvane.operators import stats


def test_bounds_of_query(spark, sf):
    values = np.array([r[0] for r in spark.read.parquet(f"{sf}/events.parquet").where("value is not null").select("value").collect()])
    rng = np.random.default_rng(1)
    means = np.concatenate([values[rng.integers(0, len(values), (500, len(values)))].mean(axis=1) for _ in range(80)])
    low, high = np.quantile(means, [0.025, 0.975])
    error = values.std() / math.sqrt(len(values))
    got = entry.queries()["bootstrap_ci"](spark, sf).first()
    # four standard deviations of a bound of 10,000 resamples, of 0.027 standard errors each
    assert abs(got.low - low) < 0.11 * error and abs(got.high - high) < 0.11 * error
    assert abs(got["mean"] - values.mean()) < 0.05 * error


def test_edges(spark):
    frame = spark.createDataFrame([(1.0,)] * 3 + [(None,), (5.0,)], "x double")
    a, b = (stats.poisson_bootstrap(f, "x", resamples=500).first() for f in (frame, frame.repartition(3)))
    assert a == b and 1.0 <= a.low < a["mean"] < a.high <= 5.0
    one = stats.poisson_bootstrap(spark.createDataFrame([(2.0,)], "x double"), "x", resamples=200).first()
    assert (one.low, one.high) == (2.0, 2.0)
    assert tuple(stats.poisson_bootstrap(frame.where("false"), "x", resamples=200).first()) == (None, None, None)


@pytest.mark.parametrize("times", [1, 3, 16, 17, 1000])
def test_draws(times):
    drawn = stats._poisson_draws(np.random.default_rng(3), times, 400_000).astype(float)
    assert abs(drawn.mean() - times) < 5 * math.sqrt(times / 400_000) and abs(drawn.var() / times - 1) < 0.02
    if times == 1:
        share = np.bincount(drawn.astype(int), minlength=5)[:5] / len(drawn)
        assert np.allclose(share, [math.exp(-1) / math.factorial(k) for k in range(5)], atol=0.004)


def test_intervals_of_many_keys(spark, monkeypatch):
    """Against a plain bootstrap, for keys of one task and of several; nulls and NaN don't count."""
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(3, 2, 400), "b": rng.exponential(1, 90), "c": np.array([2.0]), "d": np.array([1.0, 1.0, 5.0])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("a", float("nan")), ("e", None)]
    frame = spark.createDataFrame(rows, "k string, x double")
    found = {}
    for most in (10_000, 60):
        monkeypatch.setattr(stats, "SHARE_VALUES", most)
        found[most] = {r.k: r for r in stats.poisson_intervals(frame, "k", "x", 4000).collect()}
        assert set(found[most]) == set(groups)
    for k, v in groups.items():
        one, many = found[10_000][k], found[60][k]
        assert (one.n, one.low, one.high) == (many.n, pytest.approx(many.low), pytest.approx(many.high)) and one.mean == pytest.approx(v.mean()) and one.n == len(v)
        plain = rng.choice(v, (4000, len(v))).mean(axis=1)
        if len(v) > 50:
            error = v.std() / len(v) ** 0.5
            assert abs(one.low - np.quantile(plain, 0.025)) < 0.25 * error and abs(one.high - np.quantile(plain, 0.975)) < 0.25 * error
    assert (found[60]["c"].low, found[60]["c"].high) == (2.0, 2.0)
