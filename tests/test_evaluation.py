"""The whole evaluation against a plain version that works on lists, over the small tables."""

import hashlib
import re
from statistics import mean, pstdev, stdev

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_key_points import plain_kpig, units_of
from wordvane.functions import fixed, overlap
from wordvane.operators import key_points
from wordvane.plans import internals

c01 = lambda x: min(1.0, max(0.0, x))


def place(s):
    return int(hashlib.md5(s.encode()).hexdigest()[:4], 16) % key_points.DIMS


def counted(places):
    v = np.bincount(places, minlength=key_points.DIMS).astype(float) if places else np.zeros(key_points.DIMS)
    return v / max(np.linalg.norm(v), 1e-8)


def text_vector(t):
    return counted([place(w) for w in re.findall(r"\w+", t.lower())])


def unit_vector(u):
    p = f"#{u}#"
    return counted([place(p[k : k + 3]) for k in range(len(p) - 2)])


def cos(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


def harmonic(values, weights):
    return 0.0 if min(values) <= 0 else c01(sum(weights) / sum(w / v for v, w in zip(values, weights, strict=True)))


def plain(rows, judged, entailed, inside):
    """rows: (idx, input, reference, response) in order."""
    reference, source, texts = rows[0][2] or "", rows[0][1] or "", [r[3] or "" for r in rows]
    v = [text_vector(t) for t in texts]
    k, centre = len(v), np.mean(v, axis=0)
    pairs = [cos(v[i], v[j]) for i in range(k) for j in range(i)]
    penalty = mean(float(((x - centre) ** 2).sum()) for x in v)
    out = {"k": k, "sms": 1.0 if k < 2 else c01(mean(pairs) - (0.5 * penalty if penalty >= 1e-6 else 0)), "trd": 0.0 if k < 2 else c01(mean(1 - cos(x, centre) for x in v))}
    units = set().union(units_of(reference), *map(units_of, texts))
    out["kpig"] = plain_kpig(reference, texts, {u: unit_vector(u) for u in units})
    rouge = [[overlap.rouge_n(*map(overlap.rouge_tokens, (t, reference)), n) for n in (1, 2)] + [overlap.rouge_l(*map(overlap.rouge_tokens, (t, reference)))] for t in texts]
    out |= {name: mean(r[i] for r in rouge) for i, name in enumerate(("rouge1", "rouge2", "rougeL"))}
    out["auc_e"] = out["rougeL"] if k < 2 else 0.0 if out["rougeL"] < 1e-9 else c01(1 - stdev(r[2] for r in rouge) / out["rougeL"])
    cs, lengths, cover = [], [], []
    names = lambda t: set(re.findall(r"\b[A-Z][A-Za-z0-9]+\b", t))
    for t, x in zip(texts, v, strict=True):
        if not reference.strip():
            cs, lengths, cover = [*cs, 0.0], [*lengths, 0], [*cover, 0.0]
            continue
        share = len(names(reference) & names(t)) / len(names(reference)) if names(reference) else 1.0
        ratio = len(t.split()) / len(reference.split())
        fit = 0.0 if not ratio else ratio / 0.5 if ratio < 0.5 else 1.0 if ratio <= 2 else max(0.0, 1 - (ratio - 2) / 2)
        cs.append(c01(0.4 * max(0.0, cos(x, text_vector(reference))) + 0.2 * fit + 0.4 * share) * (0.6 if share < 0.2 else 1))
        lengths.append(len(t.split()))
        cover.append(share)
    out |= {"cs": mean(cs), "avg_length": mean(lengths), "avg_coverage": mean(cover), "n_irrelevant": sum(x < 0.25 for x in cs) if reference.strip() else 0, "n_missing_reference": 0 if reference.strip() else k}
    n = [len(t.split()) for t in texts]
    out["trd_length"] = 0.0 if k < 2 or not mean(n) else min(1.0, pstdev(n) ** 2 / mean(n) ** 2)
    long = lambda t: set(re.findall(r"\b\w{4,}\b", t.lower()))
    ground, facts = long(source) | long(reference), [long(t) - set(fixed.COMMON_WORDS) for t in texts]
    out["hs"] = mean(len(f - ground) / len(f) if f and ground else 0.0 for f in facts)
    said = {"entailment": 1.0, "neutral": 0.5, "contradiction": 0.0}
    out["faithfulness"] = mean(said.get(x.lower(), 0.5) for x in entailed) if entailed else 1 - out["hs"]
    marks = [int(m.group()) / 5 if (m := re.search("[0-9]", x)) else 0.5 for x, t in zip(judged, texts, strict=True) if t.strip()]
    out["human"] = mean(marks) if marks else 0.5
    out["ppl_var"], out["bf"] = inside
    p = c01(0.40 * c01(out["sms"]) + 0.35 * out["cs"] + 0.25 * out["faithfulness"]) if out["avg_length"] >= 12 else c01((0.40 * c01(out["sms"]) + 0.35 * out["cs"] + 0.25 * out["faithfulness"]) * 0.85)
    o, i = harmonic([out["sms"], out["auc_e"], out["kpig"], 1 - out["trd"]], (0.4, 0.3, 0.2, 0.1)), harmonic([1 - out["ppl_var"], 1 - out["bf"]], (0.5, 0.3))
    usd = abs(p - out["human"])
    trust = min(0.7, 0.4 + 0.3 * usd)
    out |= {"pri": p, "ori": c01((out["sms"] + out["auc_e"] + 1 - out["trd"] + out["kpig"]) / 4), "ifi": c01(1 - (out["ppl_var"] + out["bf"]) / 2), "diagnostic_ori": o, "diagnostic_ifi": i, "diagnostic_pri": harmonic([o, i], (0.5, 0.5)), "usd": usd, "ipri": c01(p * out["cs"])}
    out |= {"confidence": (out["sms"] + out["cs"] + out["faithfulness"]) / 3, "final": c01(0.6 * p + 0.4 * out["human"]), "final_dynamic": c01((1 - trust) * p + trust * out["human"]), "unstable": out["sms"] < 0.1, "hallucinated": out["hs"] > 0.5, "label": "Robust" if p >= 0.7 else "Moderate" if p >= 0.5 else "Unreliable"}
    out["remarks"] = [x for x, bad in (("very low coverage", out["avg_coverage"] < 0.2), ("too short", out["avg_length"] < 12), ("high hallucination", out["hs"] > 0.4)) if bad]
    return out


def test_evaluation_against_plain(spark, sf):
    r, judged, entailed, inside = internals.stored_inputs(spark, sf)
    rows, marks, nli = {}, {}, {}
    for x in r.collect():
        rows.setdefault(x.instance, []).append((x.idx, x.input_text, x.reference, x.response))
    for x in judged.collect():
        marks[x.instance, x.idx] = x.raw
    for x in entailed.collect():
        nli[x.instance, x.idx] = x.raw
    inner = {x.instance: (x.ppl_var or 0.0, x.bf or 0.0) for x in inside.collect()}
    found = {x.instance: x for x in entry.queries()["evaluate_stored_samples"](spark, sf).collect()}
    assert set(found) == set(rows) and any(not (x[0][2] or "").strip() for x in rows.values()) and any(len(x) == 1 for x in rows.values())
    for k, items in rows.items():
        items.sort()
        want = plain(items, [marks[k, x[0]] for x in items], [nli[k, x[0]] for x in items if (k, x[0]) in nli], inner.get(k, (0.0, 0.0)))
        for name, value in want.items():
            got = found[k][name]
            assert got == (pytest.approx(value, abs=2e-6) if isinstance(value, float) else value), (k, name)


def test_overlaps_are_the_rouge_scores_alone(spark, monkeypatch):
    """The scores of eval_metrics(), found without the character matcher and BLEU, which are thrown away here."""
    from wordvane.operators import evaluation

    rows = [(1, "The cats sat on mats, happily.", "A cat sits on the mat."), (1, None, "A cat sits on the mat."), (2, "x", None), (2, "running tests", "run the test")]
    frame = spark.createDataFrame(rows, "instance long, response string, reference string")
    each = frame.select("instance", overlap.eval_metrics(F.col("response"), F.col("reference")).alias("m")).groupBy("instance")
    want = {r[0]: tuple(r)[1:] for r in each.agg(*[F.avg(f"m.{c}") for c in ("rouge1", "rouge2", "rougeL")]).collect()}
    monkeypatch.setattr(overlap, "eval_metrics", None)
    assert {r.instance: (r.rouge1, r.rouge2, r.rougeL) for r in evaluation.overlaps(frame).collect()} == want
