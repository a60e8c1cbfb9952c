"""The shared pool and the central response against plain versions; defaults of fixed columns."""

import random

import pytest

from wordvane.functions import fixed, overlap
from wordvane.operators import acceptance
from wordvane.sources import sinks


def test_pool_against_plain(spark):
    rng = random.Random(5)
    canonical = "Write a short summary of this text in two plain sentences please"
    starts = [" ".join(rng.choices("alpha beta gamma delta epsilon zeta".split(), k=8)) for _ in range(60)]
    rows = [(level, attempt, pos, level * 1000 + attempt * 100 + pos, " ".join([rng.choice(starts), *rng.choices(["one", "two", "three"], k=rng.randrange(3))]) if rng.random() < 0.9 else canonical + rng.choice(["", " now"]), round(rng.uniform(0.7, 1.0), 3)) for level in (1, 2, 3) for attempt in range(3) for pos in range(15)]
    rows += [(1, 0, 99, 99, "too short to count", 0.9)]
    want, seen = [], {" ".join(canonical.lower().split()[:8])}
    for level in (1, 2, 3):
        got = []
        for _, _, _, i, text, sim in sorted(r for r in rows if r[0] == level):
            sig, a, b = " ".join(text.lower().split()[:8]), set(text.lower().split()), set(canonical.lower().split())
            if len(text.split()) >= fixed.POOL_WORDS and sig not in seen and 0.82 <= sim <= 0.98 and len(a & b) / len(a | b) <= 0.85:
                seen.add(sig)
                got.append(i)
        want += [(level, n, i) for n, i in enumerate(got[:3], 1)]
    found = acceptance.pool_filter(spark.createDataFrame(rows, "level long, attempt long, pos long, id long, text string, similarity double"), canonical, 3)
    assert sorted((r.level, r.nth, r.id) for r in found.collect()) == want and len(want) > 4


def test_central_response(spark):
    groups = {1: ["the cat sat on the mat", "the cat sat on a mat", "dogs bark", "the cat sat"], 2: ["alone"], 3: ["", " ", "x y"], 4: ["same text here", "same text here"]}
    found = {r.instance: (r.idx, r.mean) for r in acceptance.centroid_response(spark.createDataFrame([(k, i, t) for k, ts in groups.items() for i, t in enumerate(ts)], "instance long, idx long, text string")).collect()}
    for k, ts in groups.items():
        words = [overlap.rouge_tokens(t) for t in ts]
        means = [sum(overlap.rouge_l(w, v) for j, v in enumerate(words) if j != i) / (len(ts) - 1) if len(ts) > 1 and ts[i].strip() else 0.0 for i, w in enumerate(words)]
        best = max(range(len(ts)), key=lambda i: means[i])
        assert found[k] == (best, pytest.approx(means[best]))


def test_defaults(spark):
    frame = spark.createDataFrame([("a", None)], "k string, v int")
    row = sinks.fixed_columns(frame, "k string, v int, w string, x double", {"v": 7, "w": ""}).first()
    assert (row.k, row.v, row.w, row.x) == ("a", 7, "", None)
