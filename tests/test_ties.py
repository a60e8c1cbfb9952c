"""Equal means are equal whatever the order of their sums, and numbers are rounded as SQL rounds them."""

import datetime as dt
import itertools
import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wordvane.functions import scores

START = dt.datetime(2024, 1, 1)
KINDS = ("click", "error", "purchase", "signup", "view")


def events(spark, path, rows):
    """rows: (user, kind, value) in the order of time, or with an event number in front."""
    rows = [r if len(r) == 4 else (k, *r) for k, r in enumerate(rows)]
    frame = spark.createDataFrame([(i, START + dt.timedelta(seconds=i), u, t, v) for i, u, t, v in rows], "event_id long, ts timestamp, user_id long, event_type string, value double")
    frame.write.parquet(f"{path}/events.parquet")
    return str(path)


def test_anchors_of_equal_positions(spark, tmp_path):
    """Each position of an instance holds the same numbers, dealt otherwise to its variants: they rank by position."""
    rows = [(u, t, v) for u in range(6) for values in itertools.permutations((0.1 + u, 0.2, 0.3, 7.7, 0.01), 5) for t, v in zip(KINDS, values, strict=True)]
    sf = events(spark, tmp_path, rows)
    found = sorted((r.inst, r.pos, r.stab) for r in entry.queries()["anchors"](spark, sf).collect())
    for u in range(6):
        mine = [(p, s) for i, p, s in found if i == u]
        assert len(mine) == 36 and all(s == 2 * p for p, s in mine)


def test_threshold_of_a_mean_of_fifty(spark, tmp_path):
    """Means of exactly 50 and variances of exactly 900 aren't below."""
    rng, rows = random.Random(3), []
    for u in range(200):
        cents = [rng.randrange(0, 10_000) for _ in range(4)]
        rows += [(u, t, c / 100) for t, c in zip(KINDS, [*cents, 25_000 - sum(cents)], strict=True)]
    rows += [(900, "click", 10.1), (900, "view", 10.2)]
    sf = events(spark, tmp_path, rows)
    assert [(r.inst, r.mean) for r in entry.queries()["threshold_anchors"](spark, sf).collect()] == [(900, 10.15)]


def test_paired_tests_of_equal_means(spark, tmp_path):
    """A user whose means are equal has no difference, and differences of opposite sign that are equal share a rank."""
    rows, k = [], 0
    for user, before, after in ((1, (0.1, 0.2, 0.3), (0.2,)), (2, (0.7, 0.1, 0.1), (0.3,)), (3, (0.3,), (0.1, 0.1, 0.1)), (4, (0.1, 0.1, 0.1), (0.3,)), (5, (1.0,), (0.5,)), (6, (0.0,), (0.0,))):
        for side, values in enumerate((before, after)):
            for v in values:
                rows.append((k + side, user, "view", v))
                k += 2
    row = entry.queries()["paired_tests"](spark, events(spark, tmp_path, rows)).first()
    # Differences: 0, 0, 0.2, -0.2, 0.5, 0.
    assert (row.n_pairs, row.n_used, row.w_plus, row.w_min) == (6, 3, 4.5, 1.5)


def test_rounded_as_sql_rounds(spark):
    """Halves that doubles of the product don't have, and signs."""
    values = [x / 60000 for x in (62071.89, 74266.23, 65757.15, 7518.69, 9389.97, -9389.97)] + [0.5, -0.5, 2.5e-6, None, float("nan")]
    con = duckdb.connect()
    want = [con.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]
    found = [r.r for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double").orderBy("k").select(scores.rounded(F.col("v"), 6).alias("r")).collect()]
    assert str(found) == str(want)


def test_settled(spark):
    values = [0.1 + 0.2, 49.99999999999999, 1e300 / 3, -1e-300, 0.0, float("inf"), None]
    found = [r.r for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double").orderBy("k").select(scores.settled(F.col("v")).alias("r")).collect()]
    assert found == [0.3, 50.0, float(f"{1e300 / 3:.11e}"), -1e-300, 0.0, float("inf"), None]


def test_evaluation_of_means_just_below_a_half(spark, tmp_path):
    """Means such as 0.049999999999999996 are rounded as the SQL rounds them, by the product of doubles."""
    below, rows = [(0.71, 9.29), (30.81, 59.19), (33.12, 56.88)], []
    for user in range(40, 64):
        first, second = below[user % 3]
        rows += [(12 * user + at, user, "view", v) for at, v in ((0, first), (3, 3.0 + user), (6, second), (9, 70.0))]
    path = events(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"set threads = 1; create view events as select * from '{path}/events.parquet'")
    found = con.execute(entry.oracle_sql()["evaluation_summary"])
    names = [d[0] for d in found.description]
    want = dict(zip(names, found.fetchone(), strict=True))
    row = entry.queries()["evaluation_summary"](spark, path).first()
    for name in ("n_items", "baseline_rouge", "treated_rouge", "rouge_change", "rouge_n_used", "rouge_statistic"):
        assert getattr(row, name) == want[name], name
