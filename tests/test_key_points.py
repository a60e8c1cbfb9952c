"""Coverage by vectors, correctness and consistency against plain versions, with one huge instance, blank references and missing vectors."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordvane.functions import fixed
from wordvane.operators import key_points
from wordvane.sources.stores import lookup, staged


def units_of(text):
    tokens = [t for t in re.findall(r"\b[a-zA-Z]+\b", text.lower()) if len(t) >= 3 and t not in fixed.STOP_WORDS]
    named = {m.lower() for m in re.findall(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", text)}
    return {n for n in named if len(n) >= 3 and n not in fixed.STOP_WORDS} | set(tokens) | {f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)}


def plain_kpig(reference, responses, vectors, least=0.55):
    wanted = units_of(reference) if reference and reference.strip() else set().union(*map(units_of, responses))
    if not wanted:
        return 0.0
    corpus = ([reference] if reference and reference.strip() else []) + responses
    tf = [Counter(t for t in re.findall(r"\b\w+\b", d.lower()) if t in wanted) for d in corpus]
    df = Counter(t for c in tf for t in c)
    imp = dict.fromkeys(wanted, 0.0)
    for c in tf:
        x = {t: n * (math.log((1 + len(corpus)) / (1 + df[t])) + 1) for t, n in c.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        for t, v in x.items():
            imp[t] += v / length / len(corpus)
    imp = {t: max(0.1, v) for t, v in imp.items()}
    most = max(imp.values())
    sims, cover = {}, []
    for r in responses:
        held = [u for u in units_of(r) if u in vectors]
        hits = 0
        for w in wanted:
            best = max((float(vectors[w] @ vectors[u]) for u in held), default=0.0) if w in vectors else 0.0
            if round(best, 9) >= least:
                hits += 1
                sims.setdefault(w, []).append(best)
        cover.append(hits / len(wanted))
    weight = {w: imp[w] / most * (0.3 + 0.7 / (1 + len(sims.get(w, [])))) for w in wanted}
    base = sum(weight[w] * np.mean(sims[w]) for w in sims) / (sum(weight.values()) + 1e-8)
    return max(0.0, min(1.0, base * (1.0 if len(cover) < 2 else max(0.3, 1 - math.exp(-3 * np.std(cover))))))


@pytest.fixture(scope="module")
def cases():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeiou"), rng.integers(3, 7))) for _ in range(60)]
    text = lambda n: " ".join(w.capitalize() if rng.random() < 0.2 else w for w in rng.choice(words, n))
    rows = {k: (text(12) if k % 4 else " ", [text(int(rng.integers(0, 15))) for _ in range(1 + k % 5)]) for k in range(12)}
    rows[50] = (text(400), [text(300), text(5)])  # long: many tiles
    rows[51] = ("", ["", " "])
    rows[52] = ("the of and", ["words here"])
    return rows


@pytest.mark.parametrize("tile", [256, 7])
def test_coverage_against_plain(spark, cases, tile):
    frame = spark.createDataFrame([(k, i, ref, r) for k, (ref, rs) in cases.items() for i, r in enumerate(rs)], "instance long, idx long, reference string, response string")
    every = sorted(set().union(*(units_of(t) for ref, rs in cases.values() for t in (ref, *rs))))
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 6))
    vectors = {u: v / np.linalg.norm(v) for u in every if hash(u) is not None and len(u) % 9 for v in [centres[len(u) % 8] + rng.normal(size=6) * 0.8]}  # some units have no vector
    table = spark.createDataFrame([(u, [float(x) for x in 3 * v]) for u, v in vectors.items()], "unit string, v array<double>")
    got = {r.instance: r.kpig for r in key_points.coverage_scores(frame, staged(table), tile=tile).collect()}
    assert set(got) == set(cases)
    for k, (ref, rs) in cases.items():
        assert got[k] == pytest.approx(plain_kpig(ref, rs, vectors), abs=1e-9), k


def test_tiles_of_a_huge_instance(spark):
    """A reference of 3,000 units is dealt evenly: no tile holds more than its share."""
    words = [f"w{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(1500)]
    frame = spark.createDataFrame([(1, 0, " ".join(words), " ".join(words[::-1]))], "instance long, idx long, reference string, response string")
    texts, wanted = key_points.unit_tables(frame)
    assert wanted.count() == 2999
    shares = wanted.groupBy(F.pmod(F.xxhash64("unit"), F.lit(12)).alias("p")).count().select("count").collect()
    assert max(r["count"] for r in shares) < 4 * 250


def test_lookup_of_hot_keys(spark):
    left = staged(spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id"))
    right = staged(spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")))
    for how in ("left", "inner"):
        want = sorted(map(tuple, left.join(right, "k", how).select("k", "id", "v").collect()), key=str)
        for frequent, most in ((10_000, 10), (100, 10_000)):
            assert sorted(map(tuple, lookup(left, right, ["k"], how, frequent, most).select("k", "id", "v").collect()), key=str) == want


def test_mean_cosine_and_texts(spark):
    rows = [(1, 0, "alpha beta"), (1, 1, "alpha gamma"), (1, 2, ""), (2, 0, "one"), (3, 0, ""), (3, 1, "")]
    frame = spark.createDataFrame(rows, "instance long, idx long, t string")
    v = key_points.hashed_texts(frame, ["instance", "idx"], "t", 32)
    held = {(r.instance, r.idx): np.array(r.v) for r in v.collect()}
    assert np.linalg.norm(held[1, 0]) == pytest.approx(1) and not held[1, 2].any()
    got = {r.instance: r.mean_cos for r in key_points.mean_cosine(v, "instance").collect()}
    a, b, c = held[1, 0], held[1, 1], held[1, 2]
    assert got[1] == pytest.approx((a @ b + a @ c + b @ c) / 3) and got[2] == 1.0 and got[3] == 0.0


def test_constrained_consistency(spark):
    rows = [(1, 0, "Limit to 3 words", "one two three four"), (1, 1, "Say more.", "one two"), (2, 0, "Say.", "x"), (3, 0, "a list", " "), (4, 0, "as a list", "- x")]
    got = {r.instance: r for r in key_points.constrained_consistency(spark.createDataFrame(rows, "instance long, idx long, prompt string, response string")).collect()}
    assert got[1].compliance == pytest.approx(2 / 3) and got[1].kpig_legacy == pytest.approx(0.7 * got[1].semantic + 0.3 * 2 / 3)
    assert (got[2].kpig_legacy, got[2].compliance, got[3].kpig_legacy, got[4].kpig_legacy) == (1.0, None, 0.0, 1.0)


def test_bundles_and_tiles_hold_every_pair_of_rows_once(spark):
    """Small keys share a bundle, a large one is cut; either way each left row meets each right row of its key exactly once."""
    import pandas as pd
    from pyspark.sql import types as T

    left = staged(spark.range(2000).select((F.col("id") % 500).alias("k"), "id").unionByName(spark.range(5000, 5040).select(F.lit(7).cast("long").alias("k"), "id")))
    right = staged(left.where("k % 3 <> 2").select("k", (F.col("id") * 2).alias("other")))

    def found(a, b):
        assert a["k"].nunique() == b["k"].nunique() == 1
        return pd.DataFrame([(a["k"].iloc[0], x, y) for x in a["id"] for y in b["other"]], columns=["k", "id", "other"])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("k", "id", "other")])
    got = sorted(map(tuple, key_points.in_tiles(left, right, "k", "id", "other", 10, found, schema).collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "id", "other").collect()))


def test_best_matches_ties_and_parts(spark):
    """The first unit in the alphabet of equals, whatever the tiles; a unit that two responses hold counts for both."""
    vector = {"a": [1.0, 0.0], "b": [2.0, 0.0], "c": [1.0, 1.0], "d": [0.0, 3.0]}
    table = staged(spark.createDataFrame(list(vector.items()), "unit string, v array<double>"))
    wanted = staged(spark.createDataFrame([(1, "a"), (1, "d"), (2, "d"), (3, "none")], "instance long, unit string"))
    held = staged(spark.createDataFrame([(1, 0, "b"), (1, 0, "a"), (1, 1, "c"), (1, 2, "b"), (1, 2, "none"), (2, 0, "a"), (3, 0, "a")], "instance long, idx long, unit string"))
    for tile in (1, 2, 2048):
        got = sorted((r.instance, r.idx, r.ref, r.unit, round(r.sim, 6)) for r in key_points.best_matches(wanted, held, table, tile=tile).collect())
        assert got == [(1, 0, "a", "a", 1.0), (1, 1, "a", "c", 0.707107), (1, 1, "d", "c", 0.707107), (1, 2, "a", "b", 1.0)]


def test_vectors_made_where_units_meet(spark):
    """hashed_matrix() as a function gives what its table gives, and its table what the triples' md5 says."""
    import hashlib

    units = ["abc", "abcd", "ab", "été là", "𝒳y", "abc abd", "", "aaaaaa"]
    found = {r.unit: np.array(r.v) for r in key_points.hashed_units(spark.createDataFrame([(u,) for u in [*units, "abc", None]], "unit string")).collect()}
    assert set(found) == set(units)
    for u in units:
        p, want = f"#{u}#", np.zeros(key_points.DIMS)
        for k in range(len(p) - 2):
            want[int(hashlib.md5(p[k : k + 3].encode()).hexdigest()[:4], 16) % key_points.DIMS] += 1
        assert found[u] == pytest.approx(want / max(np.linalg.norm(want), 1e-8), abs=1e-12), u
    held = staged(spark.createDataFrame([(k % 3, k % 5, u) for k, u in enumerate(units * 6)], "instance long, idx long, unit string").distinct())
    wanted = held.select("instance", "unit").distinct()
    rows = lambda made, tile: sorted(map(tuple, key_points.best_matches(wanted, held, made, tile=tile).collect()))
    table = rows(staged(key_points.hashed_units(held)), 2048)
    assert table and all(rows(key_points.hashed_matrix, tile) == table for tile in (2, 2048))
