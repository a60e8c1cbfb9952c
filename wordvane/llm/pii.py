"""Personal data by weak supervision.

Base spans are exact: patterns and checks for email, ip, card and phone, leftmost and non-overlapping per kind; they always
stay. Besides, looser patterns propose candidates (numbers that a base pattern ran together or rejected, local phone
numbers, written-out email and ip addresses, identity numbers, titled names). Labelers of three sorts - patterns, gazetteers and
context - vote yes, no or nothing on every candidate and base span of the corpus. Expectation-maximisation estimates how
reliable each labeler is on each kind, from the counts of all vote patterns; with the posteriors as soft labels a logistic
regression is trained that decides on patterns of votes and shape. Accepted candidates are added.

Votes and shape make a key of a few thousand possible values, so that corpus-wide counts are a small table whatever the
corpus holds; only that goes to the driver. No word in a text is skipped: guards look for characters a pattern can't do without.

Defined cases: null and empty texts have no spans. Offsets are code points, ends exclusive. Repeated rows give repeated
results; other columns are ignored; no rows give none.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordvane.llm.common import in_small_batches, quoted, staged

KINDS = ("email", "ip", "card", "phone", "id", "name")
BASE_KINDS = KINDS[:4]

LOCAL = "A-Za-z0-9._%+-"
EMAIL_HERE = re.compile(rf"[{LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The same from the start of a run of its characters; a match can't start inside a run, but where the one before has ended.
EMAIL = re.compile(rf"(?<![{LOCAL}])[{LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]")
NUMBERS = re.compile("[0-9]+")

# Looser patterns of candidates, by kind.
LOOSE = (
    ("card", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])")),
    ("phone", re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9.+-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])|(?<![0-9.+-])0[0-9]{2,4}[ /-][0-9]{5,8}(?![0-9.-])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9.])[0-9]{1,3}(?: ?[\[(] ?(?:\.|dot) ?[\])] ?[0-9]{1,3}){3}(?![0-9])")),
    ("id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
)
WRITTEN_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,4}", re.I)
WRITTEN_AT = re.compile(r"[\[(] ?at ?[\])]", re.I)
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
TITLED = re.compile(rf"\b(?:{'|'.join(TITLES)})\.? [A-ZÀ-Þ][\w'’-]{{1,30}}(?: [A-ZÀ-Þ][\w'’-]{{1,30}})?")

# Gazetteers and context words of the labelers.
FIRST_NAMES = frozenset(
    """james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen
    christopher lisa daniel nancy matthew betty anthony margaret mark sandra donald ashley steven kimberly paul emily andrew donna joshua michelle kenneth carol
    kevin amanda brian melissa george deborah anna peter hans klaus ursula sabine monika jean pierre marie claire sophie luc jose juan maria carmen luis ana carlos lucia
    jan lukas leon felix jonas finn paula lena mia hannah laura julia katharina stefan andreas wolfgang dieter heike birgit petra
    jacques philippe nicolas isabelle nathalie camille antoine louis hugo manon juliette francois
    miguel javier francisco antonio manuel pedro diego pablo elena isabel pilar rosa teresa mercedes alejandro sergio
    giovanni giuseppe marco luca francesca giulia chiara alessandro ivan olga natalia dmitri sergei mohammed fatima ahmed wei li ming yuki hiroshi priya raj""".split()
)
DOMAIN_ENDS = frozenset("com org net edu gov mil int io co info biz dev app ai me tv eu uk us ca mx br ar cl de fr es it pt nl be lu ch at pl cz sk hu ro bg gr tr ru ua se no dk fi ie is ee lv lt in cn jp kr au nz za ng ke eg il sa ae sg hk tw th vn id my ph".split())
#: Countries of the account numbers of IBAN.
COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT KW KZ LB LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VG XK".split())
FOR = {
    "email": ("mail", "contact", "reach", "write", "correo", "kontakt"),
    "ip": ("ip", "address", "host", "server", "client"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "cell", "whatsapp", "telefon", "teléfono", "téléphone"),
    "id": ("ssn", "social security", "iban", "passport", "account", "konto", "compte", "cuenta"),
    "name": ("contact", "dear", "patient", "signed", "sincerely", "born"),
}
AGAINST = ("isbn", "issn", "version", "license", "licence", "order", "invoice", "doi", "page", "figure", "table", "section", "http", "www", "build", "serial", "model")
NEAR = 40


def luhn(digits: str) -> bool:
    return not sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (c > "4")) for i, c in enumerate(reversed(digits))) % 10


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        m = EMAIL.search(text)
        while m:
            out.append(("email", m.start(), m.end()))
            m = EMAIL_HERE.match(text, m.end()) or EMAIL.search(text, m.end())
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates of every kind, leftmost and non-overlapping per kind."""
    out = []
    if DIGIT.search(text):
        for kind, pattern in LOOSE:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    if WRITTEN_AT.search(text):
        out += [("email", m.start(), m.end()) for m in WRITTEN_EMAIL.finditer(text)]
    if any(t in text for t in TITLES):
        out += [("name", m.start(), m.end()) for m in TITLED.finditer(text)]
    return out


def votes(text: str, kind: str, start: int, end: int) -> str:
    """One of + - 0 for each labeler: shape, check, gazetteer, context, edges."""
    span, digits = text[start:end], NOT_DIGIT.sub("", text[start:end])
    n = len(digits)
    before = text[max(0, start - NEAR) : start].lower()
    shape = {"email": "@" in span or "at" in span.lower(), "ip": n >= 4 or ":" in span, "card": 13 <= n <= 19, "phone": 9 <= n <= 15 or (7 <= n <= 11 and span[0] in "(0"), "id": n >= 9, "name": True}[kind]
    if kind == "card":
        check = "+" if luhn(digits) else "-"
    elif kind == "id" and span[:2].isalpha():
        body = span.replace(" ", "")
        check = "+" if len(body) >= 15 and int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1 else "-"
    elif kind == "id":
        check = "+" if span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000" else "-"
    elif kind == "phone":
        check = "+" if len(set(digits)) > 2 else "-"
    elif kind == "ip":
        parts = span.split(":") if ":" in span else NUMBERS.findall(span)
        check = "+" if len(set(parts)) > 1 and (":" in span or all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in parts)) else "-"
    else:
        check = "0"
    if kind == "email":
        known = "+" if span.lower().rstrip(" )]").replace(" ", "").split(".")[-1].split("dot")[-1].strip("()[]") in DOMAIN_ENDS else "0"
    elif kind == "name":
        known = "+" if any(w.lower() in FIRST_NAMES for w in span.split()[1:]) else "0"
    elif kind == "id":
        known = "+" if span[:2] in COUNTRIES else "0"
    elif kind == "phone":
        known = "+" if span[0] == "+" else "0"
    elif kind == "card":
        known = "+" if digits[0] in "3456" else "-"
    else:
        known = "0"
    context = "+" if any(w in before for w in FOR[kind]) else "-" if any(w in before for w in AGAINST) else "0"
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = "-" if left.isalnum() or right.isalnum() or left in "/_=-" and left or right in "/_=" and right else "+"
    return ("+" if shape else "-") + check + known + context + edges


LABELERS = 5


def key_of(text: str, kind: str, start: int, end: int, sort: str) -> str:
    return f"{kind}|{votes(text, kind, start, end)}|{min(5, (end - start) // 6)}|{sort}"


def all_spans(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, is base, key) of base spans, then of candidates that meet no base span."""
    base = base_spans(text)
    out = [(k, s, e, True, key_of(text, k, s, e, "b")) for k, s, e in base]
    loose = sorted(loose_spans(text), key=lambda x: (x[1], -x[2]))
    if not loose:
        return out
    # Base spans of different kinds may overlap: of those that start before a place, the farthest end tells whether one reaches past it.
    starts = sorted(s for _, s, _ in base)
    ends = list(accumulate((e for _, e in sorted((s, e) for _, s, e in base)), max))
    last = 0
    for k, s, e in loose:
        before = bisect_left(starts, e)
        if s >= last and (not before or ends[before - 1] <= s):
            out.append((k, s, e, False, key_of(text, k, s, e, "c")))
            last = e
    return out


# Chances of each vote that the estimation starts from, by labeler (shape, check, gazetteer, context, edges), under
# truth and under falsehood. Shape and edges hold for most candidates of either sort; a failed check speaks strongly.
START = {
    1: ({"+": 0.9, "0": 0.05, "-": 0.05}, {"+": 0.6, "0": 0.37, "-": 0.03}, {"+": 0.5, "0": 0.4, "-": 0.1}, {"+": 0.3, "0": 0.65, "-": 0.05}, {"+": 0.9, "0": 0.05, "-": 0.05}),
    0: ({"+": 0.7, "0": 0.05, "-": 0.25}, {"+": 0.1, "0": 0.3, "-": 0.6}, {"+": 0.15, "0": 0.45, "-": 0.4}, {"+": 0.05, "0": 0.7, "-": 0.25}, {"+": 0.6, "0": 0.05, "-": 0.35}),
}


def reliabilities(counts: dict[str, int], rounds: int = 40) -> dict[str, float]:
    """Posterior that a span is personal data, by key, from expectation-maximisation over labelers' votes for each kind.

    Votes are independent given the truth. Base spans are true, which anchors what true spans look like; the share of true
    ones among candidates and each labeler's chances under truth and falsehood are estimated, with START as pseudo-counts.
    """
    out: dict[str, float] = {}
    by_kind: dict[str, dict[tuple[str, bool], int]] = defaultdict(lambda: defaultdict(int))
    for key, n in counts.items():
        kind, vote, _, sort = key.split("|")
        by_kind[kind][vote, sort == "b"] += n
    for kind, patterns in by_kind.items():
        strength, prior = 20.0, 0.4
        chance = {y: [dict(c) for c in START[y]] for y in (0, 1)}
        post: dict[tuple[str, bool], float] = {}
        for _ in range(rounds):
            for v, base in patterns:
                odds = math.log(prior / (1 - prior)) + sum(math.log(chance[1][j][c] / chance[0][j][c]) for j, c in enumerate(v))
                post[v, base] = 1.0 if base else 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            loose = [(post[x], n) for x, n in patterns.items() if not x[1]]
            prior = (sum(p * n for p, n in loose) + 4) / (sum(n for _, n in loose) + 10)
            for j in range(LABELERS):
                for y in (0, 1):
                    seen = {c: strength * p for c, p in START[y][j].items()}
                    for x, n in patterns.items():
                        seen[x[0][j]] += n * (post[x] if y else 1 - post[x])
                    whole = sum(seen.values())
                    chance[y][j] = {c: x / whole for c, x in seen.items()}
        for key in counts:
            k, v, _, sort = key.split("|")
            if k == kind:
                out[key] = post[v, sort == "b"]
    return out


def features(key: str) -> list[str]:
    kind, vote, length, _ = key.split("|")
    return ["bias", f"kind:{kind}", f"len:{kind}:{length}"] + [f"vote:{j}:{c}" for j, c in enumerate(vote) if c != "0"] + [f"{kind}:{j}:{c}" for j, c in enumerate(vote) if c != "0"]


def span_classifier(counts: dict[str, int], rounds: int = 300) -> dict[str, float]:
    """Probability by key: logistic regression on votes and shape, fitted to the posteriors, each key weighted by its count."""
    soft = reliabilities(counts)
    weights: dict[str, float] = defaultdict(float)
    rows = [(features(k), soft[k], math.log1p(n)) for k, n in sorted(counts.items())]
    whole = sum(n for _, _, n in rows) or 1.0
    guess = lambda f: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[x] for x in f)))))
    for _ in range(rounds):
        step: dict[str, float] = defaultdict(float)
        for f, y, n in rows:
            err = (guess(f) - y) * n / whole
            for x in f:
                step[x] += err
        for x, g in step.items():
            weights[x] -= 2.0 * (g + 1e-4 * weights[x])
    return {k: guess(features(k)) for k in counts}


ACCEPT = 0.8


def found(documents: DataFrame) -> DataFrame:
    """doc_id and spans (array of rank, start, end, kind, base, key) of every row."""

    def run(batches):
        kind = pa.list_(pa.struct([("rank", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string()), ("base", pa.bool_()), ("key", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans = [[{"rank": KINDS.index(k), "s": s, "e": e, "kind": k, "base": b, "key": key} for k, s, e, b, key in all_spans(t or "")] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return in_small_batches(documents).select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<rank:int,s:int,e:int,kind:string,base:boolean,key:string>>")


def accepted_keys(spans: DataFrame, accept: float = ACCEPT) -> list[str]:
    """Keys of candidates that the classifier takes; keys are bounded by what labelers and lengths can say (6 * 3^5 * 6 * 2)."""
    counts = {r["key"]: r["count"] for r in spans.select(F.explode("spans.key").alias("key")).groupBy("key").count().collect()}
    return sorted(k for k, p in span_classifier(counts).items() if p >= accept)


def with_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The digest columns of found()."""
    base = F.filter("spans", lambda x: x["base"])
    joined = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    kept = F.filter("spans", lambda x: x["base"] | x["key"].isin(keys)) if keys else base
    number = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *[number(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(kept).alias("spans"))


def redact(documents: DataFrame, keys: list[str]) -> DataFrame:
    """documents with every base span and accepted candidate replaced by its kind in brackets; n_chars follows. Columns stay."""
    taken = frozenset(keys)
    columns = documents.columns

    def clean(text: str) -> str:
        spans = sorted((s, e, k) for k, s, e, b, key in all_spans(text) if b or key in taken)
        if not spans:
            return text
        out, at = [], 0
        for s, e, k in spans:
            if s >= at:
                out += [text[at:s], f"[{k.upper()}]"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            texts = [clean(t) if (t := x.as_py()) is not None else None for x in batch.column("text")]
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new[f.name].cast(f.type) if f.name in new else batch.column(i) for i, f in enumerate(batch.schema)], names=columns)

    return in_small_batches(documents).select(*quoted(columns)).mapInArrow(run, T.StructType([documents.schema[c] for c in columns]))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of `documents`."""
    spans = staged(found(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return with_spans(spans, accepted_keys(spans))
