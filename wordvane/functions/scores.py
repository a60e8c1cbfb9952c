"""Composite scores: one place for their formulas. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordvane.functions import fixed


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimal places, halves away from zero, of the product as doubles have it: what SQL engines do. Spark's own round() goes by the shortest decimal numeral."""
    return F.round(x * 10.0**digits) / 10.0**digits


def settled(x: Column, digits: int = 12) -> Column:
    """x to `digits` significant digits: means of the same numbers differ behind them by the order in which they were added."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits - 1}e", x).try_cast("double"))


def harmonic(values: list[Column], weights: tuple[float, ...] | None = None) -> Column:
    """Weighted harmonic mean of clamped values, 0 as soon as one of them is 0."""
    weights = weights or tuple(1.0 for _ in values)
    if not values or sum(weights) <= 0:
        return F.lit(0.0)
    # Each value is named as seldom as can be: a method of over 8,000 bytes, which these are put into, stays interpreted.
    zero = values[0] <= 0
    for v in values[1:]:
        zero = zero | (v <= 0)
    parts = sum((F.lit(float(w)) / F.greatest(F.least(F.lit(1.0), v), F.lit(1e-9)) for v, w in zip(values, weights, strict=True)), F.lit(0.0))
    return F.when(zero, 0.0).otherwise(clamp01(F.lit(float(sum(weights))) / parts))


def harmonic_skipping(values: Column) -> Column:
    """Harmonic mean of those array elements that are over 1e-9, rounded to 4 places; 0 where there are none."""
    kept = F.filter(values, lambda v: v > 1e-9)
    return F.when(F.size(kept) == 0, 0.0).otherwise(F.round(F.size(kept) / F.aggregate(kept, F.lit(0.0), lambda s, v: s + F.try_divide(F.lit(1.0), v)), 4))


def aggregate_scores(values: list[Column], weights: tuple[float, ...], method: str) -> Column:
    """harmonic, geometric or arithmetic mean with a floor of 1e-6 under each value."""
    floored = [F.greatest(v, F.lit(1e-6)) for v in values]
    total = float(sum(weights))
    if method == "harmonic":
        return F.lit(total) / sum((F.lit(w) / v for v, w in zip(floored, weights, strict=True)), F.lit(0.0))
    if method == "geometric":
        return F.exp(sum((F.lit(w) * F.ln(v) for v, w in zip(floored, weights, strict=True)), F.lit(0.0)) / total)
    if method == "arithmetic":
        return sum((F.lit(w) * v for v, w in zip(values, weights, strict=True)), F.lit(0.0)) / total
    raise ValueError(f"unknown method {method}")


def pri(sms: Column, cs: Column, faithfulness: Column, avg_length: Column, weights=fixed.PRI_WEIGHTS) -> Column:
    base = sum((F.lit(w) * clamp01(v) for v, w in zip((sms, cs, faithfulness), weights, strict=True)), F.lit(0.0))
    return clamp01(base * F.when(avg_length < fixed.SHORT_LENGTH, fixed.SHORT_FACTOR).otherwise(1.0))


def ori(sms: Column, auc_e: Column, trd: Column, kpig: Column) -> Column:
    return clamp01((sms + auc_e + (1 - trd) + kpig) / 4)


def ifi(ppl_var: Column, bf: Column) -> Column:
    return clamp01(1 - (ppl_var + bf) / 2)


def diagnostic_ori(sms: Column, auc_e: Column, trd: Column, kpig: Column) -> Column:
    return harmonic([sms, auc_e, kpig, 1 - clamp01(trd)], fixed.DIAGNOSTIC_ORI_WEIGHTS)


def diagnostic_ifi(ppl_var: Column, bf: Column, pc_stab: Column | None = None) -> Column:
    values = [1 - clamp01(ppl_var), 1 - clamp01(bf)] + ([] if pc_stab is None else [1 - clamp01(pc_stab)])
    return harmonic(values, fixed.DIAGNOSTIC_IFI_WEIGHTS[: len(values)])


def diagnostic_pri(d_ori: Column, d_ifi: Column) -> Column:
    return harmonic([d_ori, d_ifi], fixed.DIAGNOSTIC_PRI_WEIGHTS)


def final_static(p: Column, human: Column) -> Column:
    return clamp01(fixed.FINAL_WEIGHTS[0] * p + fixed.FINAL_WEIGHTS[1] * human)


def final_dynamic(p: Column, human: Column, usd: Column, human_weight: float = fixed.FINAL_WEIGHTS[1]) -> Column:
    """The more the two disagree, the more the human score counts, up to 0.7."""
    trust = F.least(F.lit(0.7), F.lit(human_weight) + 0.3 * usd)
    return clamp01((1 - trust) * p + trust * human)


def usd(p: Column, human: Column) -> Column:
    return F.abs(p - human)


def ipri(p: Column, cs: Column) -> Column:
    return clamp01(p * cs)


def confidence(sms: Column, cs: Column, faithfulness: Column) -> Column:
    return (sms + cs + faithfulness) / 3


def diagnosis(d_ori: Column, d_ifi: Column, at: float = fixed.DIAGNOSIS_AT) -> Column:
    high_ori, high_ifi = clamp01(d_ori) >= at, clamp01(d_ifi) >= at
    return F.when(high_ori & high_ifi, "Robust").when(high_ori, "Externally Stable / Internally Fragile").when(high_ifi, "Internally Stable / Output-Sensitive").otherwise("Fragile")


def diagnosis_light(o: Column, i: Column, at: float = fixed.DIAGNOSIS_AT) -> Column:
    return F.when((o >= at) & (i >= at), "True Robustness").when(o >= at, "Evaluation Artifact").when(i >= at, "Stochastic Luck").otherwise("Knowledge Boundary")


def attribution(higher: list[Column], lower: list[Column]) -> Column:
    """Robustness type from metrics of which more is better, and of which less is."""
    vals = [clamp01(v) for v in higher] + [clamp01(1 - v) for v in lower]
    least, most = F.least(*vals), F.greatest(*vals)
    mean = sum(vals, F.lit(0.0)) / len(vals)
    return F.when(least >= 0.65, "True Robustness").when(least < 0.2, "Evaluation Artifact").when((mean >= 0.55) & (most - least > 0.35), "Stochastic Luck").otherwise("Knowledge Boundary")


def reliability(x: Column) -> Column:
    return F.when(x >= 0.70, "Robust").when(x >= 0.50, "Moderate").otherwise("Unreliable")


def colour(x: Column, invert: bool = False) -> Column:
    if invert:
        return F.when(x <= 0.1, "green").when(x <= 0.3, "yellow").otherwise("red")
    return F.when(x >= 0.7, "green").when(x >= 0.4, "yellow").otherwise("red")


def stability(std: Column) -> Column:
    return F.when(std < 0.1, "Stable").when(std <= 0.2, "Moderate").otherwise("Unstable")


def length_adequacy(response: Column, reference: Column) -> Column:
    """Of two word counts: 1 from half to twice the reference, less outside."""
    ratio = F.try_divide(response.cast("double"), reference.cast("double"))
    return F.when(reference == 0, 1.0).when(response == 0, 0.0).when(ratio < 0.5, ratio / 0.5).when(ratio <= 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (ratio - 2) / 2))


def safe_reduction(after: Column, before: Column) -> Column:
    """1 - after / before; 0 where before isn't positive."""
    return F.when(before > 0, 1 - F.try_divide(after, before)).otherwise(0.0)
