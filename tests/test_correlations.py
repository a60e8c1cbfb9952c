"""Correlations of several metrics in wide rows: against a plain version, and what they write and generate."""

import contextlib
import io
import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from wordvane.operators import significance, stats
from wordvane.plans.measures import scored


def ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def plain(pairs):
    x, y = (np.array(v, float) for v in zip(*pairs, strict=True))
    corr = lambda a, b: 0.0 if len(a) < 3 or a.std() < 1e-10 or b.std() < 1e-10 else float(np.corrcoef(a, b)[0, 1])
    return len(x), corr(x, y), corr(ranks(x), ranks(y))


def sample():
    r = random.Random(5)
    draw = lambda *some: None if r.random() < 0.15 else r.choice(some)
    rows = [(k, None if r.random() < 0.1 else r.randrange(30) / 4, draw(0.0, 1.0, 2.5), draw(*[r.random() for _ in range(9)]), 0.0, 3.0) for k in (1, 2) for _ in range(150)]
    return rows + [(3, 1.0, 2.0, None, 0.0, 3.0), (3, 4.0, 1.0, None, 0.0, 3.0), (None, 4.0, 1.0, 1.0, 0.0, 3.0)]


@pytest.mark.parametrize("near", [0, 4_000_000])
def test_wide_correlations(spark, monkeypatch, near):
    """Nulls count in neither side's ranks; with ranks of y broadcast and not."""
    monkeypatch.setattr(stats, "NEAR_NUMBERS", near)
    rows, xs = sample(), ["few", "many", "zero", "flat"]
    got = {(r.k, r.metric): r for r in stats.wide_correlations(spark.createDataFrame(rows, "k long, y double, few double, many double, zero double, flat double"), "k", xs, "y").collect()}
    assert set(got) == {(k, x) for k in (1, 2, 3, None) for x in xs}
    for (k, x), r in got.items():
        held = [(row[2 + xs.index(x)], row[1]) for row in rows if row[0] == k and row[2 + xs.index(x)] is not None]
        assert (r.rows, r.some) == (len(held), any(v != 0 for v, _ in held))
        if pairs := [p for p in held if p[1] is not None and k is not None]:
            n, pearson, spearman = plain(pairs)
            assert (r.n, r.pearson, r.spearman) == (n, pytest.approx(pearson, abs=1e-12), pytest.approx(spearman, abs=1e-12))


def test_long_rows_with_nulls(spark):
    """Ranks of y are those among rows that hold x too."""
    rows = [(1, x, y) for x, y in ((1.0, 2.0), (2.0, 8.0), (3.0, 4.0), (None, 3.0), (None, 7.0), (4.0, 9.0), (2.0, None))]
    r = stats.correlations(spark.createDataFrame(rows, "k long, x double, y double"), "k", "x", "y").first()
    assert (r.n, r.pearson, r.spearman) == tuple(pytest.approx(v) for v in plain([(x, y) for _, x, y in rows if x is not None and y is not None]))


def test_reports_agree(spark):
    rows = [r for r in sample() if None not in r]
    wide = spark.createDataFrame(rows, "k long, y double, few double, many double, zero double, flat double")
    args = ("y", ("few", "flat"))
    long = significance.correlation_report(wide.unpivot(["k", "y"], ["few", "many", "zero", "flat"], "metric", "x"), "k", "metric", "x", *args)
    found = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)
    assert found(significance.wide_correlation_report(wide, "k", ["few", "many", "zero", "flat"], *args)) == found(long)


def test_nothing_longer_than_the_samples(spark, sf, monkeypatch):
    """No step of correlation_analysis writes the eight metrics of each sample as rows, only their distinct values, of which there are 2.1 for each sample here."""
    written = []

    def noted(real):
        def staged(df):
            out = real(df)
            written.append(out.count())
            return out

        return staged

    for module in (stats, significance):
        if hasattr(module, "staged"):
            monkeypatch.setattr(module, "staged", noted(module.staged))
    samples = scored(spark, sf).count()
    entry.queries()["correlation_analysis"](spark, sf).count()
    assert written and max(written) <= 4 * samples


def test_wide_rows_are_compiled(spark, sf, monkeypatch):
    """The JVM never compiles a generated method of over 8,000 bytes; the wide rows of correlation_analysis took 8,149 while composites named each value more often."""
    taken = []
    real = significance.wide_correlation_report
    monkeypatch.setattr(significance, "wide_correlation_report", lambda wide, *args: taken.append(wide) or real(wide.limit(20), *args))
    entry.queries()["correlation_analysis"](spark, sf)
    held = spark.conf.get("spark.sql.adaptive.enabled")
    text = io.StringIO()
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        with contextlib.redirect_stdout(text):
            taken[0].explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
    assert sizes and max(sizes) <= 8000
