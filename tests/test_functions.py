"""Functions on hand-checked cases."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordvane.functions import fixed, overlap, scores, text, vectors
from wordvane.operators import perturb, stats


def value(spark, column, **cells):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()], F.lit(1).alias("_")).select(column.alias("x")).first()
    return row.x


def test_words_and_tokens(spark):
    assert value(spark, text.word_count(F.col("t")), t="  a  b\tc\n") == 3
    assert value(spark, text.word_count(F.lit(None).cast("string"))) == 0
    assert value(spark, text.tokens(F.col("t")), t="Über-Fluß, a_b 3x") == ["über", "fluß", "a_b", "3x"]
    assert value(spark, text.bigrams(text.words(F.col("t"))), t="a b c") == ["a b", "b c"]
    assert value(spark, text.bigrams(text.words(F.col("t"))), t="a") == []
    assert value(spark, text.signature(F.col("t")), t="A b C d e f g h i j") == "a b c d e f g h"
    assert value(spark, text.entities(F.col("t")), t="Anna met X and Bob2 éAnna") == ["Anna", "Bob2"]


def test_jaccard(spark):
    w = lambda t: text.words(F.lit(t))
    assert value(spark, text.jaccard(w("a b c"), w("b c d"))) == 0.5
    assert value(spark, text.jaccard(w(""), w("b"))) == 0.0


def test_key_units(spark):
    got = set(value(spark, text.key_units(F.lit("Daniel Radcliffe sang the songs"))))
    assert got == {"daniel radcliffe", "daniel", "radcliffe", "sang", "songs", "daniel radcliffe", "radcliffe sang", "sang songs"}


def test_substitution(spark):
    sub = lambda p, o, n: value(spark, text.substitute_first(F.lit(p), F.lit(o), F.lit(n)))
    assert sub("go and go", "go", "run") == "run and go"
    assert sub("stay", "go", "run") == "run\n\nstay"


def test_constraints(spark):
    c = value(spark, text.constraints(F.lit("Limit to 10 words, brief")))
    assert (c.word_limit, c.length, c.format) == (10, "short", None)
    comply = lambda p, r: value(spark, text.compliance(F.lit(r), text.constraints(F.lit(p))))
    assert comply("Limit to 10 words", " ".join("w" * 11)) == 1.0
    assert comply("Limit to 10 words", " ".join("w" * 15)) == 0.5
    assert comply("anything", "x") == 1.0
    assert comply("a list please", "- one\n- two") == 1.0
    assert comply("in 0 words", "x") == 0.0


@pytest.mark.parametrize("raw, score", [("4", 0.8), ("Score: 10", 0.2), ("n/a", 0.5), ("7", 1.4)])
def test_judge(spark, raw, score):
    assert value(spark, text.judge_score(F.lit(raw))) == pytest.approx(score)


def test_perturbations(spark):
    assert value(spark, text.double_negation(F.lit("This is fine"))) == "This is not not fine"
    assert value(spark, text.double_negation(F.lit("Thisis fine"))) == "Thisis fine"
    assert value(spark, text.formality_shift(F.lit("I do not know"))) == "I don't know"
    assert value(spark, text.formality_shift(F.lit("I don't know, they're out"))) == "I do not know, they are out"
    row = spark.createDataFrame([("One. Two! Three?", "alphabet soup", "This")], "a string, b string, c string")
    made = row.select(perturb.reordered(F.col("a"), F.lit(3)).alias("a"), perturb.typo(F.col("b"), F.lit(1)).alias("b"), perturb.hedged(F.col("c"), F.lit(0)).alias("c")).first()
    assert sorted(made.a.replace(".", "").replace("!", "").replace("?", "").split()) == ["One", "Three", "Two"]
    assert sorted(made.b.replace(" ", "")) == sorted("alphabetsoup") and made.b != "alphabet soup"
    assert made.c.endswith(" this")


def test_cleaning(spark):
    assert value(spark, text.clean_generation(F.lit('Rephrased version: "Hello there\nworld"'))) == "Hello there world"
    assert value(spark, text.clean_generation(F.lit("a b\nNote: skipped\nmore"))) == "a b"
    assert value(spark, text.unmarked_lines(F.lit("1. one two three four five six\n- short"))) == ["one two three four five six"]


@pytest.mark.parametrize("ratio, want", [((1, 4), 0.5), ((2, 4), 1), ((8, 4), 1), ((12, 4), 0.5), ((16, 4), 0), ((0, 4), 0), ((3, 0), 1)])
def test_length_adequacy(spark, ratio, want):
    assert value(spark, scores.length_adequacy(F.lit(ratio[0]), F.lit(ratio[1]))) == want


def test_scores(spark):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    assert value(spark, scores.pri(*lit(0.8, 0.6, 0.4, 12))) == pytest.approx(0.63)
    assert value(spark, scores.pri(*lit(1, 1, 1, 11))) == pytest.approx(0.85)
    for o, i, p, d in ((1.0, 0.0, 0.0, "Externally Stable / Internally Fragile"), (0.8, 0.8, 0.8, "Robust"), (0.2, 0.8, 0.32, "Internally Stable / Output-Sensitive"), (0.2, 0.2, 0.2, "Fragile")):
        assert value(spark, scores.diagnostic_pri(*lit(o, i))) == pytest.approx(p)
        assert value(spark, scores.diagnosis(*lit(o, i))) == d
    assert value(spark, scores.harmonic(lit(0.5, 0.0))) == 0.0
    assert value(spark, scores.harmonic_skipping(F.array(*lit(0.5, 0.0, 0.5)))) == 0.5
    assert value(spark, scores.attribution(lit(0.7, 0.9), lit(0.1))) == "True Robustness"
    assert value(spark, scores.attribution(lit(0.1, 0.9), lit(0.1))) == "Evaluation Artifact"
    assert value(spark, scores.attribution(lit(0.95, 0.5), lit(0.3))) == "Stochastic Luck"
    with pytest.raises(ValueError):
        scores.aggregate_scores(lit(1), (1.0,), "median")


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert value(spark, vectors.cosine(a, b)) == 0 and value(spark, vectors.distance(a, b)) == pytest.approx(math.sqrt(5))
    assert value(spark, vectors.unit(b)) == [0.0, 1.0]
    assert value(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_word_lists():
    assert len(fixed.STRATEGIES) == 16 and [len(v) for v in fixed.STRATEGIES_BY_TASK.values()] == [15, 12, 9, 9]
    assert len(fixed.CONTRACTIONS) == 15 and len(set(fixed.STOP_WORDS)) == len(fixed.STOP_WORDS)


@pytest.mark.parametrize("word, root", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control")])
def test_porter(word, root):
    assert overlap.stem(word) == root


def test_overlap():
    assert overlap.lcs("a b c d e".split(), "a c x e b".split()) == 3
    assert overlap.rouge_n("a b c".split(), "a b d".split(), 2) == pytest.approx(0.5)
    assert overlap.rouge_l([], ["a"]) == 0.0 and overlap.bleu("", "x") == 0.0
    assert overlap.bleu("the cat is on the mat", "the cat is on the mat") == 1.0
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert overlap.lcs(a, b) == t[-1][-1]


def test_p_values():
    assert stats.correlation_p(0.0, 10) == pytest.approx(1.0)
    # r = 0.6319 is the two-sided 5 % point for n = 10
    assert stats.correlation_p(0.6319, 10) == pytest.approx(0.05, abs=1e-4)
    # by enumeration of all signs
    for n, w in ((5, 15), (6, 17), (7, 10)):
        sums = Counter(sum(r for k, r in enumerate(range(1, n + 1)) if m >> k & 1) for m in range(1 << n))
        assert stats.wilcoxon_p(w, n) == pytest.approx(sum(c for s, c in sums.items() if s >= w) / 2**n)
    assert stats.wilcoxon_p(60 * 61 / 4, 60) == pytest.approx(0.5)
    low, high = stats.bootstrap_interval([1.0, 2.0, 3.0, 4.0], resamples=500)
    assert 1 <= low < 2.5 < high <= 4


def test_correlations_and_ranks(spark):
    frame = spark.createDataFrame([("m", float(x), float(y)) for x, y in ((1, 2), (2, 4), (3, 6), (4, 9), (4, 9))], "k string, x double, y double")
    row = stats.correlations(frame, "k", "x", "y").first()
    assert row.n == 5 and row.spearman == pytest.approx(1.0) and 0.98 < row.pearson < 1
    constant = spark.createDataFrame([("m", 1.0, float(y)) for y in range(5)], "k string, x double, y double")
    assert stats.correlations(constant, "k", "x", "y").first().pearson == 0.0
    d = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (2.0,)], "d double")
    w = stats.signed_rank(d, "d").first()
    assert (w.n_used, w.w_plus, w.w_min) == (3, 4.5, 1.5)


def test_word_levenshtein(spark):
    distance = overlap.word_levenshtein(F.col("a"), F.col("b"))
    assert value(spark, distance, a="the cat sat on mat", b="a cat on the red mat") == 4
    many = " ".join(f"w{i}" for i in range(60_000))
    assert value(spark, F.length(overlap.word_levenshtein(F.col("a"), F.col("b")).cast("string")), a=many[:200], b=many[:100]) > 0


def test_word_levenshtein_of_long_texts_is_quick(spark):
    def edits(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    rng = random.Random(1)
    some = [" ".join(rng.choices(["ba", "ab", "\u00a0", "c\u3000c", "D"], k=rng.choice((0, 1, 5, 63, 64, 65, 130)))) for _ in range(60)]
    pairs = [(x, y) for x in some[:30] for y in some[30:]] + [(None, "a b"), (None, None), (" \t", "a")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", overlap.word_levenshtein(F.col("a"), F.col("b")).alias("d")).collect()
    split = lambda t: [w for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if w]
    assert all(r.d == edits(split(r.a), split(r.b)) for r in rows)
    long = [f"w{i}" for i in range(20_000)]
    began = time.time()
    assert value(spark, overlap.word_levenshtein(F.col("a"), F.col("b")), a=" ".join(long), b=" ".join(long[7:] + ["x"] * 3)) == 10
    assert time.time() - began < 30
