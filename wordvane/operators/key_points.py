"""Key-point coverage by stored unit vectors: units of a reference are met by the most similar unit of each response, from a least cosine on.

An encoder is anything that gives a table (unit, v), or a function of units; `hashed_matrix` is one that needs no model, `hashed_units` its table. Similar units are sought within an instance: small ones are dealt to bundles, large ones cut into tiles of about TILE x TILE units by
responses, of which a long one is a tile of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wordvane.functions import scores, text, vectors
from wordvane.sources.stores import lookup, staged

LEAST_COSINE = 0.55
LEAST_IMPORTANCE = 0.1
TILE = 2048
#: Rows of both sides that a bundle of small instances holds, about.
BUNDLE = 20_000
DIMS = 64


def bucket(item: Column, dims: int = DIMS) -> Column:
    """A place from 0 on that depends on the string alone; md5, so that other engines can repeat it."""
    return (F.conv(F.substring(F.md5(item), 1, 4), 16, 10).cast("int") % dims).cast("int")


_LETTER = 21  # bits of a code point


@lru_cache(maxsize=1_000_000)
def _place(triple: int, dims: int) -> int:
    """bucket() of three letters, given as a number."""
    letters = (triple >> 2 * _LETTER, triple >> _LETTER, triple)
    return int(hashlib.md5("".join(chr(x & (1 << _LETTER) - 1) for x in letters).encode()).hexdigest()[:4], 16) % dims


def hashed_matrix(units, dims: int = DIMS) -> np.ndarray:
    """Unit vectors of units' letter triples, hashed to `dims` places, a row each. Units that share triples lie near each other."""
    padded = [f"#{u}#" for u in units]
    owner = np.repeat(np.arange(len(padded)), [len(p) for p in padded])
    code = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.int64)
    starts = np.flatnonzero(owner[2:] == owner[:-2])  # of triples within a unit
    triples, at = np.unique((code[starts] << 2 * _LETTER) | (code[starts + 1] << _LETTER) | code[starts + 2], return_inverse=True)
    places = np.array([_place(t, dims) for t in triples.tolist()], np.int64)
    counts = np.bincount(owner[starts] * dims + places[at], minlength=len(padded) * dims).reshape(len(padded), dims).astype(float)
    return counts / np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1e-8)


def hashed_units(units: DataFrame, dims: int = DIMS) -> DataFrame:
    """unit, v of the distinct units: hashed_matrix() as a table."""

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(hashed_matrix(batch.column(0).to_pylist(), dims)), pa.list_(pa.float64()))], names=["unit", "v"])

    return units.select("unit").where("unit is not null").distinct().mapInArrow(encode, "unit string, v array<double>")


def spread(rows: DataFrame, keys: list[str], places: Column, dims: int) -> DataFrame:
    """keys, v of every row: how often each place from 0 to dims - 1 is among its places, scaled to length 1; all-zero where it has none."""
    counted = rows.select(*keys, F.explode(places).alias("at")).groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("n"))
    lists = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))  # dims entries at most
    # The length is a column of its own: within the lambda it would be found anew for each place.
    v = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.coalesce(F.try_element_at("m", k) / F.col("len"), F.lit(0.0)))
    return rows.select(*keys).join(lists, keys, "left").select(*keys, v.alias("v"))


def unit_tables(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, wanted), both written. texts: instance, idx (-1: the reference), tokens, units. wanted: instance, unit, the units of the
    reference, or of all responses where the reference is blank.

    responses: instance, idx, reference, response. A reference is read once for each instance; null and blank ones are no text.
    """
    own = responses.select("instance", F.col("idx").cast("long").alias("idx"), F.col("response").alias("t"))
    base = responses.groupBy("instance").agg(F.max("reference").alias("t"))
    blank = F.trim(F.regexp_replace(F.coalesce("t", F.lit("")), r"\s+", " ")) == ""
    texts = own.unionByName(base.where(~blank).select("instance", F.lit(-1).cast("long").alias("idx"), "t"))
    texts = staged(texts.select("instance", "idx", text.tokens(F.col("t")).alias("tokens"), text.key_units(F.col("t")).alias("units")))
    referred = texts.where("idx = -1").select("instance")
    from_reference = texts.where("idx = -1").select("instance", F.explode("units").alias("unit"))
    from_all = texts.join(referred, "instance", "left_anti").select("instance", F.explode("units").alias("unit")).distinct()
    return texts, staged(from_reference.unionByName(from_all))


def importance(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """instance, unit, imp of every wanted unit: its mean TF-IDF over the texts (idf ln((1 + n) / (1 + df)) + 1, each text's weights over
    the wanted units of length 1), at least LEAST_IMPORTANCE, over the instance's greatest. Units of several words are never met as tokens."""
    n = texts.groupBy("instance").agg(F.count(F.lit(1)).alias("n"))
    tf = texts.select("instance", "idx", F.explode("tokens").alias("unit")).groupBy("instance", "idx", "unit").agg(F.count(F.lit(1)).alias("tf")).join(wanted, ["instance", "unit"], "left_semi")
    df = F.count(F.lit(1)).over(Window.partitionBy("instance", "unit"))
    x = tf.withColumn("df", df).join(n, "instance").withColumn("x", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = x.groupBy("instance", "idx").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    mean = x.join(length, ["instance", "idx"]).groupBy("instance", "unit").agg((F.sum(F.col("x") / F.col("len")) / F.first("n")).alias("imp"))
    floored = wanted.join(mean, ["instance", "unit"], "left").withColumn("imp", F.greatest(F.coalesce("imp", F.lit(0.0)), F.lit(LEAST_IMPORTANCE)))
    most = floored.groupBy("instance").agg(F.max("imp").alias("most"))
    return floored.join(most, "instance").select("instance", "unit", (F.col("imp") / F.col("most")).alias("imp"))


def in_tiles(left: DataFrame, right: DataFrame, key: str, left_item: str, right_item: str, tile: int, found, schema) -> DataFrame:
    """found(a, b) of each key's rows of both sides, as pandas frames. Give it written tables.

    Keys of up to `tile` rows on either side are dealt to bundles of about BUNDLE rows, so that a group of Spark's is many keys. Sides of larger keys are cut
    into tiles of about that many rows by left_item and right_item, and each left tile meets each right one: found() sees parts of them.
    """
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both may come from one table
    sizes = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    tiles = lambda n, name: F.ceil(F.col(n) / tile).cast("int").alias(name)
    cuts = staged(sizes(left, "ln").join(sizes(right, "rn"), key).select(key, tiles("ln", "lt"), tiles("rn", "rt"), (F.col("ln") + F.col("rn")).alias("n")))
    small = (F.col("lt") == 1) & (F.col("rt") == 1)
    bundles = max((cuts.where(small).agg(F.sum("n")).first()[0] or 0) // BUNDLE, 4 * left.sparkSession.sparkContext.defaultParallelism)
    cuts = cuts.select(key, "lt", "rt", F.when(small, F.pmod(F.xxhash64(key), F.lit(bundles))).alias("_bundle"), F.when(~small, F.col(key).cast("string")).alias("_large"))
    place = [F.coalesce("_bundle", F.lit(-1)).alias("_bundle"), F.coalesce("_large", F.lit("")).alias("_large"), "_lt", "_rt"]

    def dealt(df: DataFrame, item: str, own: str, other: str):
        cut = lookup(df, cuts, [key], "inner")
        placed = cut.withColumn(f"_{own}", F.pmod(F.xxhash64(item), F.col(own)).cast("int")).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return placed.select(*df.columns, *place).groupBy("_bundle", "_large", "_lt", "_rt")

    def each(a, b):
        import pandas as pd

        of = b.groupby(key, sort=False).indices
        out = [found(x, b.iloc[of[k]]) for k, x in a.groupby(key, sort=False) if k in of]
        # Joined by numpy: concatenated strings of pandas are chunked, which Spark doesn't take.
        return pd.DataFrame({f.name: pd.Series(np.concatenate([x[f.name].to_numpy() for x in out]) if out else [], dtype=object if f.dataType == T.StringType() else None) for f in schema})

    return dealt(left, left_item, "lt", "rt").cogroup(dealt(right, right_item, "rt", "lt")).applyInPandas(each, schema)


def _vectors(frame, name: str) -> np.ndarray:
    return np.stack(frame[name].to_numpy())


#: Pairs of units whose cosines a task holds at once.
PAIRS_AT_ONCE = 4_000_000


def best_matches(wanted: DataFrame, held: DataFrame, unit_vectors: DataFrame | Callable, least: float = LEAST_COSINE, tile: int = TILE) -> DataFrame:
    """instance, idx, ref, unit, sim: of each response the unit most similar to a wanted one, the first in the alphabet of equals, where their cosine,
    rounded to 9 digits, is `least` or more. A unit without a vector is in none.

    unit_vectors: a table (unit, v), or a function such as hashed_matrix() that gives unit vectors of any units, which is then called where units meet,
    so that no vector is looked up or shuffled. Units that several responses hold are compared once. Only the best of each response and wanted unit leaves a tile.
    """
    encode = None if isinstance(unit_vectors, DataFrame) else unit_vectors
    left, right = wanted.select("instance", F.col("unit").alias("ref")), held.select("instance", "idx", "unit")
    if encode is None:
        known = unit_vectors.select("unit", vectors.unit(F.col("v")).alias("v"))
        left = lookup(left, known.withColumnsRenamed({"unit": "ref", "v": "rv"}), ["ref"], "inner")
        right = lookup(staged(right), known.withColumnRenamed("v", "uv"), ["unit"], "inner")
    left, right = staged(left.where("ref is not null")), staged(right.where("unit is not null"))

    def closest(a, b):
        import pandas as pd

        ref, idx = a["ref"].to_numpy(), b["idx"].to_numpy()
        units, first, at = np.unique(b["unit"].to_numpy().astype(object), return_index=True, return_inverse=True)  # in the order of the alphabet
        if encode is None:
            there, mine = _vectors(b.iloc[first], "uv"), _vectors(a, "rv")
        else:
            there, mine = np.split(encode([*units, *ref]), [len(units)])
        of = np.argsort(at, kind="stable")  # rows by unit
        counts = np.bincount(at, minlength=len(units))
        ends = np.cumsum(counts)
        block, parts = max(1, PAIRS_AT_ONCE // len(units)), []
        for start in range(0, len(ref), block):
            sims = mine[start : start + block] @ there.T
            r, u = np.nonzero(sims > least - 1e-6)
            sim = np.round(sims[r, u], 9)
            r, u, sim = r[near := sim >= least], u[near], sim[near]
            # Each near pair for each row that holds the unit.
            n = counts[u]
            row = of[np.repeat(ends[u] - np.cumsum(n), n) + np.arange(n.sum())]
            r, u, sim, i = np.repeat(r, n), np.repeat(u, n), np.repeat(sim, n), idx[row]
            order = np.lexsort((u, -sim, i, r))
            r, u, sim, i = r[order], u[order], sim[order], i[order]
            new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (i[1:] != i[:-1])][: len(r)])
            parts.append((i[new], ref[start + r[new]], units[u[new]], sim[new]))
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return pd.DataFrame({"instance": [a["instance"].iloc[0]] * len(columns[0])} | dict(zip(("idx", "ref", "unit", "sim"), columns, strict=True)))

    schema = T.StructType([wanted.schema["instance"], held.schema["idx"], T.StructField("ref", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("sim", T.DoubleType())])
    found = in_tiles(left, right, "instance", "ref", "idx", tile, closest, schema)
    best = F.min(F.struct((-F.col("sim")).alias("less"), F.col("unit"))).alias("b")  # of a response's tiles
    return found.groupBy("instance", "idx", "ref").agg(best).select("instance", "idx", "ref", F.col("b.unit").alias("unit"), (-F.col("b.less")).alias("sim"))


def coverage_scores(responses: DataFrame, unit_vectors: DataFrame | Callable | None = None, least: float = LEAST_COSINE, tile: int = TILE) -> DataFrame:
    """instance, kpig, base, coverage, n_units, n_matched of every instance.

    base is the sum over matched units of weight times mean similarity, over the sum of all weights; a weight is importance
    times 0.3 + 0.7 / (1 + responses that match the unit). kpig is base times what coverage varies by over responses, 1 - exp(-3 sd), 0.3 at least, or
    1 for a single response. An instance without units scores 0; responses without units cover 0. Repeated units count once.
    """
    texts, wanted = unit_tables(responses)
    held = texts.where("idx >= 0").select("instance", "idx", F.explode("units").alias("unit"))
    matches = staged(best_matches(wanted, held, hashed_matrix if unit_vectors is None else unit_vectors, least, tile))
    met = matches.groupBy("instance", F.col("ref").alias("unit")).agg(F.count(F.lit(1)).alias("freq"), F.avg("sim").alias("avg_sim"))
    weighed = importance(texts, wanted).join(met, ["instance", "unit"], "left").withColumn("w", F.col("imp") * (0.3 + 0.7 / (1 + F.coalesce("freq", F.lit(0)))))
    base = weighed.groupBy("instance").agg((F.sum(F.col("w") * F.coalesce("avg_sim", F.lit(0.0))) / (F.sum("w") + 1e-8)).alias("base"), F.count(F.lit(1)).alias("n_units"), F.count("freq").alias("n_matched"))
    hits = matches.groupBy("instance", "idx").agg(F.count(F.lit(1)).alias("hits"))
    each = texts.where("idx >= 0").select("instance", "idx").join(hits, ["instance", "idx"], "left").join(base, "instance", "left")
    each = each.withColumn("c", F.coalesce(F.try_divide(F.coalesce("hits", F.lit(0)).cast("double"), F.col("n_units").cast("double")), F.lit(0.0)))
    first = lambda c, default: F.coalesce(F.first(c), F.lit(default)).alias(c)
    out = each.groupBy("instance").agg(first("base", 0.0), first("n_units", 0), first("n_matched", 0), F.avg("c").alias("coverage"), F.stddev_pop("c").alias("sd"), F.count(F.lit(1)).alias("k"))
    varied = F.when(F.col("k") < 2, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - F.exp(-3 * F.col("sd"))))
    kpig = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("base") * varied))
    return out.select("instance", kpig.alias("kpig"), "base", "coverage", "n_units", "n_matched")


def hashed_texts(texts: DataFrame, keys: list[str], t: str, dims: int = DIMS) -> DataFrame:
    """keys, v of every row of texts: counts of its tokens hashed to `dims` places, scaled to length 1; all-zero where there are none.

    Tokens are counted before they meet, so a text is one short row however long it is.
    """
    return spread(texts.select(*keys, t), keys, F.transform(text.tokens(F.col(t)), lambda w: bucket(w, dims)), dims)


def mean_cosine(rows: DataFrame, key: str, v: str = "v") -> DataFrame:
    """key, k, mean_cos: the mean cosine over a key's pairs of rows, from the length of their summed unit vectors: no pairs are made.

    Zero vectors have cosine 0 with all. A key of one row has the mean 1.
    """
    n2 = vectors.dot(F.col(v), F.col(v))
    long = rows.select(key, F.posexplode(v).alias("pos", "x")).groupBy(key, "pos").agg(F.sum("x").alias("x"))
    total = long.groupBy(key).agg(F.sum(F.col("x") * F.col("x")).alias("s2"))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.sum(n2).alias("own"))
    k = F.col("k").cast("double")
    return sizes.join(total, key, "left").select(key, "k", F.when(F.col("k") < 2, 1.0).otherwise(F.try_divide(F.col("s2") - F.col("own"), k * (k - 1))).alias("mean_cos"))


def constrained_consistency(responses: DataFrame, alpha: float = 0.7) -> DataFrame:
    """instance, kpig_legacy, semantic, compliance. responses: instance, idx, prompt, response.

    alpha of the responses' mean pairwise cosine (0 at least; 1 for a single one), the rest of the mean compliance of responses whose
    prompt asks for something; where none does, the cosine alone. An instance of blank responses scores 0.
    """
    asked = text.constraints(F.col("prompt"))
    rows = responses.select("instance", F.col("idx").cast("long").alias("idx"), F.coalesce("response", F.lit("")).alias("t"), asked.alias("asked"))
    any_asked = F.coalesce(F.col("asked.word_limit").cast("string"), F.col("asked.length"), F.col("asked.format")).isNotNull()
    own = rows.groupBy("instance").agg(F.avg(F.when(any_asked, text.compliance(F.col("t"), F.col("asked")))).alias("compliance"), F.bool_or(F.col("t").rlike(r"\S")).alias("some"))
    cos = mean_cosine(hashed_texts(rows, ["instance", "idx"], "t"), "instance").withColumn("semantic", F.greatest(F.lit(0.0), F.coalesce("mean_cos", F.lit(0.0))))
    both = own.join(cos, "instance")
    mixed = F.when(F.col("compliance").isNull(), F.col("semantic")).otherwise(alpha * F.col("semantic") + (1 - alpha) * F.col("compliance"))
    return both.select("instance", F.when(~F.col("some"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed))).alias("kpig_legacy"), "semantic", "compliance")


def correctness(responses: DataFrame, response_vectors: DataFrame, reference_vectors: DataFrame) -> DataFrame:
    """instance, idx, cosine, adequacy, entity_coverage, cs, n_words, flag of each response.

    responses: instance, idx, reference, response; vectors: (instance, idx, v) and (instance, v). cs is 0.4 cosine (0 at least) + 0.2 length
    adequacy + 0.4 share of the reference's entities met (1 where it has none), from 0 to 1, times 0.6 where that share is below 0.2. A blank
    reference gives 0 in everything and the flag missing_reference; a cs below 0.25 is irrelevant.
    """
    rows = responses.select("instance", F.col("idx").cast("long").alias("idx"), F.coalesce("reference", F.lit("")).alias("reference"), F.coalesce("response", F.lit("")).alias("response"))
    both = rows.join(response_vectors.select("instance", "idx", F.col("v").alias("_v")), ["instance", "idx"], "left").join(reference_vectors.select("instance", F.col("v").alias("_r")), "instance", "left")
    there, c = F.col("reference").rlike(r"\S"), F.col
    given = lambda x: F.when(there, x).otherwise(0.0)
    wanted, met = text.entities(c("reference")), text.entities(c("response"))
    share = F.when(F.size(wanted) == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(wanted, met)).cast("double"), F.size(wanted).cast("double")))
    n = text.word_count(c("response"))
    out = both.select("instance", "idx", there.alias("_there"), given(F.coalesce(F.greatest(F.lit(0.0), vectors.cosine(c("_v"), c("_r"))), F.lit(0.0))).alias("cosine"), given(scores.length_adequacy(n, text.word_count(c("reference")))).alias("adequacy"), given(share).alias("entity_coverage"), given(n.cast("double")).alias("n_words"))
    mixed = scores.clamp01(0.4 * c("cosine") + 0.2 * c("adequacy") + 0.4 * c("entity_coverage"))
    out = out.withColumn("cs", F.when(c("entity_coverage") < 0.2, mixed * 0.6).otherwise(mixed))
    return out.withColumn("flag", F.when(~c("_there"), "missing_reference").when(c("cs") < 0.25, "irrelevant")).drop("_there")


def token_matching(texts: DataFrame, token_vectors: DataFrame, tile: int = TILE) -> DataFrame:
    """pair, precision, recall, f1, available: greedy matching of each token with the most similar one of the other text, both ways.

    texts: pair, reference, response; token_vectors: unit, v (made outside, of any length). Tokens count as often as they stand. A token without a vector is
    similar to none; where a text has tokens but no vector at all nothing can be matched, and available is false. Blank texts give zeros.
    """
    long = texts.select("pair", F.explode(F.array(F.struct(F.lit("p").alias("side"), F.col("response").alias("t")), F.struct(F.lit("r").alias("side"), F.col("reference").alias("t")))).alias("s")).select("pair", "s.*")
    counts = staged(long.select("pair", "side", F.explode(text.tokens(F.col("t"))).alias("unit")).groupBy("pair", "side", "unit").agg(F.count(F.lit(1)).alias("n")))
    known = staged(lookup(counts, token_vectors.select("unit", vectors.unit(F.col("v")).alias("v")), ["unit"], "inner"))

    def products(a, b):
        import pandas as pd

        sims = _vectors(a, "v") @ _vectors(b, "v").T
        return pd.DataFrame({"pair": [a["pair"].iloc[0]] * (len(a) + len(b)), "side": ["p"] * len(a) + ["r"] * len(b), "unit": [*a["unit"], *b["unit"]], "best": [*sims.max(axis=1), *sims.max(axis=0)]})

    schema = T.StructType([texts.schema["pair"], T.StructField("side", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("best", T.DoubleType())])
    of = lambda side: known.where(F.col("side") == side).select("pair", "unit", "v")
    best = in_tiles(of("p"), of("r"), "pair", "unit", "unit", tile, products, schema).groupBy("pair", "side", "unit").agg(F.max("best").alias("best"))
    met = counts.join(known.select("pair", "side", "unit", F.lit(1).alias("has")), ["pair", "side", "unit"], "left").join(best, ["pair", "side", "unit"], "left")
    side = lambda s, c: F.when(F.col("side") == s, F.col(c))
    mean = lambda s: F.coalesce(F.try_divide(F.sum(F.when(F.col("side") == s, F.col("n") * F.coalesce("best", F.lit(0.0)))), F.sum(side(s, "n"))), F.lit(0.0))
    there = lambda s: (F.count(side(s, "n")) == 0) | (F.count(side(s, "has")) > 0)
    sums = met.groupBy("pair").agg(mean("p").alias("precision"), mean("r").alias("recall"), (there("p") & there("r")).alias("available"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return texts.select("pair").join(sums.withColumn("f1", f1), "pair", "left").select("pair", zero("precision"), zero("recall"), zero("f1"), F.coalesce("available", F.lit(True)).alias("available"))
