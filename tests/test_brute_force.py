"""Queries without SQL, held against plain Python on the smallest tables."""

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

import __spark_entry__ as entry
from wordvane.functions import fixed
from wordvane.functions.overlap import stem


@pytest.fixture(scope="module")
def talks(spark, sf):
    """Texts of each conversation, in order of turns."""
    out = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        out[r.conv_id].append(r)
    return out


def edits(a, b):
    table = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (x != y))
    return table[len(a), len(b)]


def common_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def stems(text):
    return [stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", (text or "").lower())]


def f_score(hits, n, m):
    return 2 * (hits / n) * (hits / m) / (hits / n + hits / m) if hits else 0.0


def rouge_l(a, b):
    x, y = stems(a), stems(b)
    return f_score(common_length(x, y), len(x), len(y))


def rouge_n(a, b, n):
    grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    x, y = grams(stems(a)), grams(stems(b))
    return f_score(sum(min(k, y[g]) for g, k in x.items()), sum(x.values()), sum(y.values()))


def bleu(a, b):
    c, r = (a or "").lower().split(), (b or "").lower().split()
    if not set(c) & set(r):
        return 0.0
    product = 1.0
    for n in range(1, 5):
        x = Counter(tuple(c[i : i + n]) for i in range(len(c) - n + 1))
        y = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        hits = sum(min(k, y[g]) for g, k in x.items())
        product *= (hits if hits else 0.1) / max(1, sum(x.values()))
    return round(product**0.25 * min(1.0, math.exp(1 - len(r) / len(c))), 4)


def test_word_levenshtein(spark, sf, talks):
    found = {r.conv_id: r for r in entry.queries()["word_levenshtein_diversity"](spark, sf).collect()}
    for conv, rows in talks.items():
        lists = [(r.text or "").split() for r in rows]
        each = [edits(a, b) for a, b in combinations(lists, 2)]
        if each:
            assert math.isclose(found[conv].mean_distance, sum(each) / len(each), abs_tol=1e-6) and found[conv].diverse == (sum(each) / len(each) >= 10)
    assert len(found) == sum(len(rows) > 1 for rows in talks.values())


def test_rouge_bundle(spark, sf, talks):
    found = {(r.conv_id, r.pos): r for r in entry.queries()["rouge_bundle"](spark, sf).collect()}
    n = 0
    for conv, rows in talks.items():
        for pos, (q, a) in enumerate(zip([r.text for r in rows if r.role == "user"], [r.text for r in rows if r.role == "assistant"])):
            r = found[conv, pos]
            n += 1
            for got, want in ((r.rouge1, rouge_n(a, q, 1)), (r.rouge2, rouge_n(a, q, 2)), (r.rougeL, rouge_l(a, q)), (r.bleu, bleu(a, q))):
                assert math.isclose(got, want, abs_tol=1e-6)
            assert r.exact_match == int(" ".join((a or "").lower().split()) == " ".join((q or "").lower().split()))
    assert n == len(found) > 0


def test_consistency_and_spread(spark, sf, talks):
    light = {r.conv_id: r for r in entry.queries()["consistency_light"](spark, sf).collect()}
    spread = {r.conv_id: r for r in entry.queries()["rouge_auc_e"](spark, sf).collect()}
    for conv, rows in talks.items():
        reference, later = rows[0].text, [r.text for r in rows[1:]]
        if not later:
            continue
        own = [rouge_l(x, reference) for x in later]
        pairs = [rouge_l(x, y) for x, y in combinations(later, 2)]
        cs, mean = sum(pairs) / len(pairs) if pairs else 1.0, sum(own) / len(own)
        assert math.isclose(light[conv].cs, cs, abs_tol=1e-4)
        assert math.isclose(light[conv].hs, 0.4 * mean + 0.35 * sum(bleu(x, reference) for x in later) / len(later) + 0.25 * cs, abs_tol=1e-4)
        sd = math.sqrt(sum((x - mean) ** 2 for x in own) / (len(own) - 1)) if len(own) > 1 else 0.0
        auc = mean if len(own) < 2 else 0.0 if mean < 1e-9 else min(1.0, max(0.0, 1 - sd / mean))
        assert math.isclose(spread[conv].auc_e, auc, abs_tol=1e-5) and math.isclose(spread[conv].rouge_mean, mean, abs_tol=1e-5)


def test_greedy_accept(spark, sf, talks):
    found = defaultdict(list)
    for r in entry.queries()["greedy_accept"](spark, sf).collect():
        found[r.instance].append((r.variant_idx, r.attempt, r.strategy))
    tokens = lambda t: set(re.findall(r"[^\W]+", (t or "").lower()))
    near = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    for conv, rows in talks.items():
        base, taken, signatures, used = rows[0].text or "", [], set(), Counter()
        for r in rows[1:]:
            t, words = r.text or "", (r.text or "").split()
            mark = " ".join(w.lower() for w in words[:8])
            if len(taken) < 4 and used[r.role] < fixed.PER_STRATEGY and len(words) >= fixed.LEAST_WORDS and t.strip().lower() != base.strip().lower() and mark not in signatures:
                if near(tokens(t), tokens(base)) <= fixed.OVERLAP_MOST and all(near(tokens(t), x) <= fixed.OVERLAP_MOST for _, _, _, x in taken):
                    taken.append((len(taken), r.turn, r.role, tokens(t)))
                    signatures.add(mark)
                    used[r.role] += 1
        assert sorted(found[conv]) == [x[:3] for x in taken]


def test_text_cleaning(spark, sf):
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in entry.queries()["text_cleaning"](spark, sf).collect():
        t = texts[r.doc_id]
        kept = []
        for line in t.strip(" ").strip("\"'").split("\n") if t.strip() else []:
            line = line.strip(" ")
            if not line or line.lower().startswith(fixed.META_LINES):
                break
            kept.append(line)
        assert r.flat_md5 == md5(t.replace("\n", " ")) and r.n_cut == (1503 if len(t) > 1500 else len(t))
        assert r.n_sentences == sum(len(s.split()) >= 4 for s in re.split(r"(?<=[.!?])\s+", t.strip(" ")))
        if not t.lstrip() != t and not t.lower().startswith("rephrased"):
            assert r.clean_md5 == md5(" ".join(kept))


def test_evaluate_samples(spark, sf, talks):
    words = lambda t: (t or "").split()
    long = lambda t: {w for w in re.findall(r"\w+", (t or "").lower()) if len(w) >= 4}
    named = lambda t: {w for w in re.findall(r"\w+", t or "") if re.fullmatch("[A-Z][A-Za-z0-9]+", w)}
    found = {r.conv_id: r for r in entry.queries()["evaluate_samples"](spark, sf).collect()}
    for conv, rows in talks.items():
        ref, later = rows[0].text, [r.text for r in rows[1:]]
        if not later:
            continue
        n = [len(words(x)) for x in later]
        mean = lambda v: sum(v) / len(v)
        novel = [len(long(x) - long(ref)) / len(long(x)) if long(x) else 0.0 for x in later]
        cover = [len(named(ref) & named(x)) / len(named(ref)) if named(ref) else 1.0 for x in later]
        r = found[conv]
        assert r.k == len(later) and math.isclose(r.avg_length, mean(n), abs_tol=1e-5)
        assert math.isclose(r.hs, mean(novel), abs_tol=1e-5) and math.isclose(r.coverage, mean(cover), abs_tol=1e-5)
        drift = 0.0 if len(n) < 2 or not mean(n) else min(1.0, mean([(x - mean(n)) ** 2 for x in n]) / mean(n) ** 2)
        assert math.isclose(r.trd, drift, abs_tol=1e-5) and math.isclose(r.faithfulness, 1 - mean(novel), abs_tol=1e-5)
        assert ("hallucinated" in r.flags) == (mean(novel) > 0.5)
