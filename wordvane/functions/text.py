"""Text expressions: words, tokens, signatures, templates, constraints, perturbations. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordvane.functions import fixed

#: Where a run of letters, digits and underscores begins and ends: a pattern between them stands for whole tokens.
WORD_START, WORD_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def words(text: Column) -> Column:
    """Whitespace-separated words; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, counted without making them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def token_count(text: Column) -> Column:
    """Number of tokens, counted without making them."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]++"))


def long_words(text: Column, least: int = 4) -> Column:
    """Set of tokens of at least `least` characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"([\p{{L}}\p{{N}}_]{{{least},}}+)"), 1))


def entities(text: Column) -> Column:
    """Set of capitalised ASCII words of two characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{WORD_START}([A-Z][A-Za-z0-9]++){WORD_END}"), 1))


def ascii_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")).cast("double") / F.greatest(F.length(text), F.lit(1))


def signature(text: Column, n: int = 8) -> Column:
    """The first n words, lower-cased."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+", n + 2)  # the rest of the text, in one piece, is the last
    return F.array_join(F.slice(F.filter(parts, lambda w: w != ""), 1, n), " ")


def bigrams(items: Column) -> Column:
    """Adjacent pairs, joined by a blank."""
    n = F.size(items)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(items, F.lit(1), n - 1), F.slice(items, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b)))


def content_tokens(text: Column, least: int = 3) -> Column:
    """ASCII-letter tokens of at least `least` letters that are no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"{WORD_START}([a-z]{{{least},}}+){WORD_END}"), 1)
    return F.filter(found, lambda w: ~w.isin(*fixed.STOP_WORDS))


def key_units(text: Column, least: int = 3) -> Column:
    """Set of capitalised sequences, content tokens and pairs of neighbouring content tokens."""
    named = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"), 1)
    named = F.filter(F.transform(named, F.lower), lambda w: (F.length(w) >= least) & ~w.isin(*fixed.STOP_WORDS))
    # As an element of an array content is found once; bigrams() names it several times.
    content = F.transform(F.array(content_tokens(text, least)), lambda c: F.concat(c, bigrams(c)))
    return F.array_distinct(F.concat(named, F.element_at(content, 1)))


def substitute_first(prompt: Column, old: Column, new: Column) -> Column:
    """prompt with the first place of old replaced by new; new before the prompt where old isn't in it."""
    at = F.position(old, prompt)
    return F.when(at > 0, F.concat(F.substr(prompt, F.lit(1), at - 1), new, F.substr(prompt, at + F.length(old)))).otherwise(F.concat(new, F.lit("\n\n"), prompt))


def clean_generation(raw: Column) -> Column:
    """Generated text without its label and quotes, up to the first blank or meta line, lines joined by blanks."""
    bare = F.trim(F.regexp_replace(F.trim(raw), r"(?i)^rephrased version:\s*", ""))
    bare = F.regexp_replace(bare, "^[\"']+|[\"']+$", "")
    meta = "^(" + "|".join(m.replace("(", r"\(") for m in fixed.META_LINES) + ")"
    lines = F.transform(F.split(bare, "\n"), F.trim)
    state = F.aggregate(
        lines,
        F.struct(F.lit(False).alias("stop"), F.array().cast("array<string>").alias("kept")),
        lambda s, x: F.struct((s["stop"] | (x == "") | F.lower(x).rlike(meta)).alias("stop"), F.when(s["stop"] | (x == "") | F.lower(x).rlike(meta), s["kept"]).otherwise(F.concat(s["kept"], F.array(x))).alias("kept")),
    )
    return F.array_join(state["kept"], " ")


def unmarked_lines(raw: Column, least: int = 6) -> Column:
    """Lines without list markers that have at least `least` words."""
    lines = F.transform(F.split(raw, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^[0-9]+[.)]\s*", ""), r"^[-*•]\s*", "")))
    return F.filter(lines, lambda x: word_count(x) >= least)


def constraints(prompt: Column) -> Column:
    """struct(word_limit, length, format) of what a prompt asks for; null where it doesn't."""
    p = F.lower(prompt)
    limit = F.regexp_extract(p, r"(?:in|under|maximum|max|limit to)\s+([0-9]+)\s+words?", 1)
    return F.struct(
        F.when(limit != "", limit.cast("int")).alias("word_limit"),
        F.when(p.rlike(r"\b(short|brief|concise)\b"), "short").when(p.rlike(r"\b(detailed|long|comprehensive)\b"), "long").alias("length"),
        F.when(p.rlike(r"\b(bullet points|bullets|list)\b"), "list").alias("format"),
    )


def is_list(response: Column) -> Column:
    """Whether a line starts with a list marker."""
    return response.rlike(r"(^|\n)(\s*[-*•]\s|\s*[0-9]+\.\s)")


def compliance(response: Column, asked: Column) -> Column:
    """Mean compliance with what is asked for; 1 where nothing is."""
    return compliance_of(word_count(response), is_list(response), asked)


def compliance_of(words: Column, listed: Column, asked: Column) -> Column:
    """compliance() of a response of so many words that is a list or isn't: where one response meets many prompts it is read once."""
    n, limit = words.cast("double"), asked["word_limit"].cast("double")
    parts = F.array_compact(
        F.array(
            F.when(limit.isNotNull(), F.when(n <= limit * 1.1, 1.0).when(limit == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(n - limit, limit)))),
            F.when(asked["length"] == "short", F.when(n < 100, 1.0).otherwise(0.5)).when(asked["length"] == "long", F.when(n >= 50, 1.0).otherwise(0.5)),
            F.when(asked["format"] == "list", F.when(listed, 1.0).otherwise(0.0)),
        )
    )
    return F.when(F.size(parts) == 0, 1.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))


def judge_score(raw: Column) -> Column:
    """First digit over 5; 0.5 where there is none. Not clamped."""
    digit = F.regexp_extract(raw, "([0-9])", 1)
    return F.when(digit != "", digit.cast("double") / 5).otherwise(0.5)


def entailment_score(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.contains("entailment"), 1.0).when(low.contains("neutral"), 0.5).when(low.contains("contradiction"), 0.0).otherwise(0.5)


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def exact_match(a: Column, b: Column) -> Column:
    return (normalised(a) == normalised(b)).cast("int")


def double_negation(text: Column) -> Column:
    """" not not" after the first copula, in any case."""
    return F.regexp_replace(text, r"(?is)^(.*?(?<![\p{L}\p{N}_])(?:is|are|was|were|am|be|been|being)(?![\p{L}\p{N}_]))", "$1 not not")


def formality_shift(text: Column) -> Column:
    """Contracts where at least as many expanded forms as contracted ones are present, else expands; each pair in its order."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    count = lambda forms: sum((F.when(padded.contains(f), 1).otherwise(0) for f in forms), F.lit(0))
    contracted, expanded = padded, padded
    for long, short in fixed.CONTRACTIONS:
        contracted = F.replace(contracted, F.lit(long), F.lit(short))
        expanded = F.replace(expanded, F.lit(short), F.lit(long))
    return F.trim(F.when(count([x for x, _ in fixed.CONTRACTIONS]) >= count([y for _, y in fixed.CONTRACTIONS]), contracted).otherwise(expanded))


def hashed_uniform(key: Column) -> Column:
    """First 8 hexadecimal digits of md5 over 2^32 - 1."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def truncated(text: Column, n: int, mark: str = "") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)
