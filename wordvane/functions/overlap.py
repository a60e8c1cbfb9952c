"""Overlap of two texts: ROUGE, BLEU, character matching, word edit distance. Plain Python for Arrow UDFs; the built-in functions have none of these."""



import difflib
import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in VOWELS and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(stem: str) -> int:
    """Number of vowel-consonant turns."""
    kinds = ["c" if _consonant(stem, i) else "v" for i in range(len(stem))]
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:]))


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 3) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 1) and w[-1] not in "wxy"


# Porter's suffix rules of steps 2 to 4 (public, Porter 1980).
STEP2 = tuple(zip("ational tional enci anci izer abli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti".split(), "ate tion ence ance ize able al ent e ous ize ate ate al ive ful ous al ive ble".split(), strict=True))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """Porter's stemmer."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(suffix):
                w = w[: -len(suffix)] + new if _measure(w[: -len(suffix)]) > 0 else w
                break
    for suffix in sorted([*STEP4, "ion"], key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if _measure(w) > 1 and _double(w) and w[-1] == "l":
        w = w[:-1]
    return w


def rouge_tokens(text: str) -> list[str]:
    return [stem(w) if len(w) > 3 else w for w in re.sub("[^a-z0-9]+", " ", (text or "").lower()).split()]


def f1(hits: float, a: int, b: int) -> float:
    return 2 * hits / (a + b) if a and b and hits else 0.0


def rouge_n(a: list[str], b: list[str], n: int) -> float:
    x, y = (Counter(zip(*(t[i:] for i in range(n)))) for t in (a, b))
    return f1(sum((x & y).values()), sum(x.values()), sum(y.values()))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit rows: one big integer per word of b."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row = 0
    for w in b:
        x = at.get(w, 0) | row
        row = x & ~(x - ((row << 1) | 1)) if x else row
    return row.bit_count()


def rouge_l(a: list[str], b: list[str]) -> float:
    return f1(lcs(a, b), len(a), len(b))


def bleu(candidate: str, reference: str) -> float:
    """BLEU-4 with uniform weights; a precision without hits counts 0.1 hits; rounded to 4 places."""
    c, r = (candidate or "").lower().split(), (reference or "").lower().split()
    if not c or not r:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        x, y = (Counter(zip(*(t[i:] for i in range(n)))) for t in (c, r))
        total = max(1, sum(x.values()))
        hits = sum((x & y).values())
        if n == 1 and not hits:
            return 0.0
        logs += math.log((hits or 0.1) / total) / 4
    return round(math.exp(logs + min(0.0, 1 - len(r) / len(c))), 4)


def char_ratio(a: str, b: str) -> float:
    return round(difflib.SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio(), 4)


def _metrics(response: pd.Series, reference: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(response.fillna(""), reference.fillna(""), strict=True):
        x, y = rouge_tokens(a), rouge_tokens(b)
        same = int(" ".join(a.lower().split()) == " ".join(b.lower().split()))
        rows.append((rouge_n(x, y, 1), rouge_n(x, y, 2), rouge_l(x, y), bleu(a, b), char_ratio(a, b), same))
    return pd.DataFrame(rows, columns=["rouge1", "rouge2", "rougeL", "bleu", "lex_sim", "exact_match"])


def _rouge(response: pd.Series, reference: pd.Series) -> pd.DataFrame:
    read = lru_cache(maxsize=1000)(rouge_tokens)  # a reference meets many responses
    rows = []
    for a, b in zip(response.fillna(""), reference.fillna(""), strict=True):
        x, y = read(a), read(b)
        rows.append((rouge_n(x, y, 1), rouge_n(x, y, 2), rouge_l(x, y)))
    return pd.DataFrame(rows, columns=["rouge1", "rouge2", "rougeL"])


def _rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(rouge_tokens(x), rouge_tokens(y)) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype="float64")


# UDFs are made at each use: executors import this module without a session.
def eval_metrics(response: Column, reference: Column) -> Column:
    """struct of all pair metrics; each text is tokenised once. Blank responses have 0 everywhere."""
    return F.pandas_udf(_metrics, "rouge1 double, rouge2 double, rougeL double, bleu double, lex_sim double, exact_match int")(response, reference)


def rouge(response: Column, reference: Column) -> Column:
    """struct of the three ROUGE scores that eval_metrics() holds, without BLEU and the character matcher, whose time grows with the product of both lengths."""
    return F.pandas_udf(_rouge, "rouge1 double, rouge2 double, rougeL double")(response, reference)


def rouge_l_score(a: Column, b: Column) -> Column:
    return F.pandas_udf(_rouge_l, "double")(a, b)


#: Words between white space as Spark's split takes it.
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def _places(items: list[str]) -> dict[str, int]:
    """Of each word, the places where it stands, as bits of one integer."""
    out: dict[str, int] = {}
    for k, w in enumerate(items):
        out[w] = out.get(w, 0) | 1 << k
    return out


def word_edits(short: list[str], n: int, places: dict[str, int]) -> int:
    """Levenshtein distance of a list and another of n items, given by places: Myers' bit rows, one step an item (Hyyro's form for whole lists)."""
    if not n:
        return len(short)
    full, top, out = (1 << n) - 1, 1 << (n - 1), n
    up, down = full, 0
    for w in short:
        same = places.get(w, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rise = down | (full & ~(diagonal | up))
        fall = up & diagonal
        if rise & top:
            out += 1
        elif fall & top:
            out -= 1
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | (full & ~(diagonal | rise)), rise & diagonal
    return out


def _word_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[str, tuple[list[str], dict[str, int]]] = {}  # a text meets many others

    def read(t: str) -> tuple[list[str], dict[str, int]]:
        if t not in seen:
            seen[t] = (w := _WORD.findall(t), _places(w))
        return seen[t]

    def distance(x: str, y: str) -> int:
        if x == y:
            return 0
        (u, up), (v, vp) = read(x), read(y)
        return word_edits(u, len(v), vp) if len(u) <= len(v) else word_edits(v, len(u), up)

    return pd.Series([distance(x, y) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype="int32")


def word_levenshtein(a: Column, b: Column) -> Column:
    """Levenshtein distance of word lists; null counts as empty. A pair takes as many steps of integers as its shorter text has words."""
    return F.pandas_udf(_word_levenshtein, "int")(a, b)
