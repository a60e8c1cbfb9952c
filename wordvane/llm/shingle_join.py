"""Exact self-join of documents by the Jaccard similarity of their word 5-gram sets, by adaptive multi-match prefixes.

A document's set is ordered by (estimated frequency, token): rare shingles first. If two sets of sizes m, n are linked, they
share at least ceil(0.8 * max(m, n)) shingles, so their first m - ceil(0.8 m) + l and n - ceil(0.8 n) + l shingles share at
least l. Each document picks its own l from 1 to LEVELS: one more shingle in the prefix costs a look-up of all documents
with it, and one more required match saves verifications; l is where the estimated sum is least. Of a pair, the smaller l
is required. Frequencies come from counts of all shingles in 2^SKETCH_BITS cells; any order is correct, a good one is fast.

Groups of copies can hold a third of all rows, so no step lists all pairs of a group:

1. Documents of equal sets are one class from the start (counts and sums of set hashes, pre-aggregated).
2. Star pass: in each list of documents with a prefix shingle, every one is paired with the list's first only. Verified
   pairs join documents to components; a group of near copies mostly becomes one component, from a linear number of pairs. Lists of frequent
   shingles are dealt to several tasks.
3. Exact pass: only in lists with two components or more the rows of other components than the largest are joined with the list, and only pairs of different components,
   of fitting sizes and with room for enough shared shingles (by the places of the one they meet in) come out. All such
   pairs with enough matches are verified. Links within a component don't change components, so none that matters is lost.

Verification takes both whole texts and compares whole sets. Components are found by alternating hook-and-jump steps on
written tables. Set elements are 64-bit hashes of the shingles' words.

Defined cases: null texts and texts without words have an empty set and link with nothing; fewer than 5 words are one
shingle. Repeated rows give repeated results; different texts under one doc_id are one document with that component.
Rows without a doc_id take no part and get a null component. Other columns are ignored. No rows give none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordvane.llm.common import in_small_batches, small, staged

WORDS_EACH = 5
#: Links from this many hundredths of the union on.
PERCENT = 80
LEVELS = 3
SKETCH_BITS = 18
#: A list head is tried by the star pass from so many hundredths of a document's shingles in common on (prefixes hold 20).
STAR_PERCENT = 3
#: Cost of verifying a pair, in look-ups of one document.
VERIFY = 50.0
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_rng = np.random.default_rng(20240229)
#: A random 64-bit number for each byte, an odd factor and its inverse modulo 2^64: a word's hash is a polynomial of its bytes.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
POSITIONS = _rng.integers(1, 2**63, WORDS_EACH, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, factor: np.uint64, _held: dict = {}) -> np.ndarray:  # noqa: B006
    """factor^0 .. factor^(n - 1) modulo 2^64, kept."""
    got = _held.get(int(factor))
    if got is None or len(got) < n:
        got = _held[int(factor)] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(max(n, 1 << 16), factor, np.uint64))])
    return got[:n]


def word_hashes(text: str) -> np.ndarray:
    """A hash of every word, in order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[data] * powers(len(data), FACTOR), dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * powers(len(data), INVERSE)[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    n = max(1, len(words) - WORDS_EACH + 1)
    total = np.full(n, np.uint64(len(words) if len(words) < WORDS_EACH else WORDS_EACH))
    for k in range(min(WORDS_EACH, len(words))):
        total = total + words[k : k + n] * POSITIONS[k]
    return np.unique(mixed(total))


def needed(n: np.ndarray | int):
    """Shingles that a set of n has to share to be linked with any: ceil(0.8 * n)."""
    return -(-(PERCENT * n) // 100)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and 100 * both >= PERCENT * (len(a) + len(b) - both)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


#: A cell of the sketch is heavy from so many times the median on, and LEAST_HEAVY more; lists of its tokens are dealt to SALTS parts.
HEAVY, LEAST_HEAVY, SALTS = 16, 10_000, 64


def heavy_cells(frequency: np.ndarray) -> list[int]:
    """The sketch's heavy cells: a sixteenth of all at most, as their counts are 16 times the median or more."""
    return np.flatnonzero(frequency > HEAVY * np.median(frequency) + LEAST_HEAVY).tolist()


SETS = "doc_id long, tag long, n long, sum_a long, sum_b long, cells binary"


def set_digests(documents: DataFrame) -> DataFrame:
    """Of each row (doc_id, tag, text) its set's size and two sums of its hashes, which name the set; besides one row per task with
    n -1 and the counts of all its shingles in cells of the frequency sketch."""
    names = ["doc_id", "tag", "n", "sum_a", "sum_b", "cells"]

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            texts, out = batch.column("text"), []
            for at in range(0, batch.num_rows, 256):
                sets = [shingles(t) for t in texts.slice(at, 256).to_pylist()]
                out += [(len(s), s.sum(dtype=np.uint64), mixed(s ^ FACTOR).sum(dtype=np.uint64)) for s in sets]
                if len(cells := np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)):
                    counts += np.bincount(cells.astype(np.int64), minlength=len(counts))
            n, a, b = (np.array(c, t) for c, t in zip(zip(*out, strict=True), (np.int64, np.uint64, np.uint64), strict=True)) if out else ([], [], [])
            columns = [pa.array(n, pa.int64()), *(pa.array(signed(np.asarray(c)), pa.int64()) for c in (a, b))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), *columns, pa.nulls(batch.num_rows, pa.binary())], names=names)
        one = lambda x: pa.array([x], pa.int64())
        yield pa.RecordBatch.from_arrays([one(None), one(0), one(-1), one(0), one(0), pa.array([zlib.compress(np.minimum(counts, 2**31 - 1).astype("<i4").tobytes(), 1)], pa.binary())], names=names)

    return documents.mapInArrow(run, SETS)


def sketch_of(digests: DataFrame) -> np.ndarray:
    """Sum of all tasks' cells: 2^SKETCH_BITS numbers, added in pairs of tasks on the executors first."""

    def add(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for cell in batch.column("cells"):
                total += np.frombuffer(zlib.decompress(cell.as_py()), "<i4")
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["cells"])

    parts = digests.where("n = -1").select("cells").coalesce(8).mapInArrow(add, "cells binary").collect()  # 8 rows of 2 MB
    return sum((np.frombuffer(r["cells"], "<i8") for r in parts), np.zeros(1 << SKETCH_BITS, np.int64))


def prefix(s: np.ndarray, frequency: np.ndarray, floor: float, levels: int = LEVELS) -> tuple[np.ndarray, int]:
    """The shingles of a set's prefix at its own level, and that level."""
    n = len(s)
    f = frequency[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    first = n - int(needed(n)) + 1
    most = min(n, first + levels - 1)
    order = np.lexsort((s, f))[:most]
    others = np.cumsum(np.maximum(0.0, f[order] - floor))
    best, cost = 1, np.inf
    for level in range(1, most - first + 2):
        candidates = others[first + level - 2]
        here = (first + level) * 1.0 + candidates + VERIFY * candidates / level
        if here < cost:
            best, cost = level, here
    return s[order[: first + best - 1]], best


def prefix_rows(documents: DataFrame, frequency: np.ndarray) -> DataFrame:
    """(token, doc, info) of the prefixes of all class representatives. documents: doc, text, tag.

    info is one number, so that rows stay short: the set's size n, the token's place at in its order, and the level, which also
    tells apart the texts of one doc (4 * (tag modulo 31) more than the level itself). unpacked() takes it apart.
    """
    floor = float(np.median(frequency)) + 4 * float(np.median(frequency)) ** 0.5  # what unrelated shingles add to a cell
    cells = frequency.astype(np.float32)

    def run(batches):
        for batch in batches:
            ids, texts, tags = batch.column("doc").to_pylist(), batch.column("text"), batch.column("tag").to_pylist()
            for at in range(0, batch.num_rows, 256):
                columns: list[list] = [[], [], []]
                for d, t, tag in zip(ids[at : at + 256], texts.slice(at, 256).to_pylist(), tags[at : at + 256], strict=True):
                    s = shingles(t)
                    if len(s):
                        p, level = prefix(s, cells, floor)
                        info = (len(s) << (AT_BITS + LEVEL_BITS)) + (np.arange(len(p), dtype=np.int64) << LEVEL_BITS) + level + 4 * (tag % 31)
                        for column, value in zip(columns, (signed(p), np.full(len(p), d, np.int64), info), strict=True):
                            column.append(value)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["token", "doc", "info"])

    return documents.select("doc", "text", "tag").mapInArrow(run, "token long, doc long, info long")


#: A set's size takes what these leave of 63 bits: documents of up to 2^28 shingles.
AT_BITS, LEVEL_BITS = 28, 7


def n_of(info: Column) -> Column:
    return F.shiftright(info, AT_BITS + LEVEL_BITS)


def at_of(info: Column) -> Column:
    return F.shiftright(info, LEVEL_BITS) % (1 << AT_BITS)


def level_of(info: Column) -> Column:
    return info % (1 << LEVEL_BITS)


def reaches(shared: Column, n_x: Column, at_x: Column, n_y: Column, at_y: Column) -> Column:
    """Whether two sets can be linked that share at most `shared` tokens up to one at places at_x, at_y: what follows in both is all that may come."""
    most = shared + F.least(n_x - at_x, n_y - at_y) - 1
    return (100 + PERCENT) * most >= PERCENT * (n_x + n_y)


def sizes_fit(n_x: Column, n_y: Column) -> Column:
    return (100 * n_x >= PERCENT * n_y) & (100 * n_y >= PERCENT * n_x)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b), a written table, whose whole sets are linked. texts: doc, text. Only texts of documents in pairs move.

    b, of which many pairs may hold the same, gets its text first (a skewed join that Spark splits), a second.
    """
    named = lambda c: small(staged(pairs.select(F.col(c).alias("doc")).distinct()))
    of = lambda c: texts.join(named(c), "doc", "left_semi").select(F.col("doc").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            good = []
            for at in range(0, batch.num_rows, 64):
                x, y = (batch.column(c).slice(at, 64).to_pylist() for c in ("text_a", "text_b"))
                good += [linked(shingles(p), shingles(q)) for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node that can be reached. Hook and jump on written tables.

    Each round every root takes the smallest root among its neighbours' (one aggregation of links), then labels jump to their
    label's label. Links within one component go. Rounds are about the logarithm of a component's width.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = staged(nodes.withColumn("root", F.col("node")))
    live = staged(links.distinct())
    while live.take(1):
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("least")).where("least < a").select(F.col("a").alias("root"), "least")
        # Roots point to smaller roots only, so following pointers ends; jump until none moves.
        hook = staged(hook)
        while True:
            up = hook.select(F.col("root").alias("least"), F.col("least").alias("_next"))
            jumped = staged(hook.join(up, "least", "left").select("root", F.coalesce("_next", "least").alias("least"), F.col("_next").isNotNull().alias("moved")))
            hook = jumped.select("root", "least")
            if not jumped.where("moved").take(1):
                break
        labels = staged(labels.join(hook, "root", "left").select("node", F.coalesce("least", "root").alias("root")))
        ends = live.join(hook.withColumnRenamed("root", "a").withColumnRenamed("least", "_a"), "a", "left").select(F.coalesce("_a", "a").alias("a"), "b")
        ends = ends.join(hook.withColumnRenamed("root", "b").withColumnRenamed("least", "_b"), "b", "left").select("a", F.coalesce("_b", "b").alias("b"))
        live = staged(ends.where("a <> b").distinct())
    return labels


def class_texts(documents: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, texts): (n, sum_a, sum_b, doc) of each set met, named by its smallest doc_id, and (doc, text, tag) of the row so named.

    rows: doc_id, tag, n, sum_a, sum_b of the rows that have an id and a set. Rows that name no class are taken away, by broadcast where
    they are few; a row that is there several times is kept once.
    """
    each = rows.groupBy("n", "sum_a", "sum_b", "doc_id", "tag").agg(F.count(F.lit(1)).alias("times"))
    heads = staged(each.groupBy("n", "sum_a", "sum_b").agg(F.min(F.struct("doc_id", "tag", "times")).alias("head")).select("n", "sum_a", "sum_b", F.col("head.doc_id").alias("doc"), F.col("head.tag").alias("tag"), F.col("head.times").alias("times")))
    names = heads.select(F.col("doc").alias("doc_id"), "tag").distinct()
    others = small(staged(each.select("doc_id", "tag").distinct().join(names, ["doc_id", "tag"], "left_anti")))
    repeated = small(staged(heads.where("times > 1").select(F.col("doc").alias("doc_id"), "tag").distinct()))
    with_words = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    first = with_words.join(others, ["doc_id", "tag"], "left_anti")
    once = first.join(repeated, ["doc_id", "tag"], "left_anti").select("doc_id", "text", "tag")
    several = first.join(repeated, ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"]).select("doc_id", "text", "tag")
    return heads.select("n", "sum_a", "sum_b", "doc"), once.union(several).withColumnRenamed("doc_id", "doc")


def join(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of documents (doc_id, text)."""
    documents = in_small_batches(documents).select("doc_id", "text", F.xxhash64("text").alias("tag"))
    digests = staged(set_digests(documents))
    frequency = sketch_of(digests)
    rows = digests.where("n >= 0").drop("cells")
    classes, texts = class_texts(documents, rows.where("n > 0 and doc_id is not null"))
    members = staged(rows.where("n > 0 and doc_id is not null").join(classes, ["n", "sum_a", "sum_b"]).select("doc_id", "doc").distinct())
    # An id with different texts is in several classes: they share its component.
    least = members.groupBy("doc_id").agg(F.min("doc").alias("b"), F.max("doc").alias("_most")).where("b < _most")
    same_id = members.join(least, "doc_id").where("b < doc").select(F.col("doc").alias("a"), "b").distinct()

    c = F.col
    # The list of a token whose cell is among the heavy ones may hold a large part of all documents: it is dealt to SALTS lists, whose ends are
    # put together afterwards.
    heavy = F.shiftrightunsigned("token", 64 - SKETCH_BITS).isin(heavy_cells(frequency))
    part = F.when(heavy, F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(0)
    in_list = Window.partitionBy("token", "part")
    met = prefix_rows(texts, frequency).withColumn("part", part).withColumn("first", F.min(F.struct("doc", "info")).over(in_list)).withColumn("last", F.max("doc").over(in_list))
    met = staged(met.where(heavy | (c("first.doc") < c("last"))).select("token", "doc", "info", "first", "last"))
    ends = staged(met.where(heavy).groupBy("token").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first.doc < last"))
    listed = met.where(~heavy).drop("last").unionByName(met.where(heavy).drop("first", "last").join(small(ends.drop("last")), "token"))

    # Star pass: the two list heads that a document shares most prefix shingles with, where those are some part of its prefix. It decides
    # nothing for good: pairs that it leaves out are the exact pass's.
    n, at, head_n, head_at = n_of(c("info")), at_of(c("info")), n_of(c("first.info")), at_of(c("first.info"))
    met = listed.where((c("first.doc") < c("doc")) & sizes_fit(n, head_n) & reaches(F.least(at, head_at) + 1, n, at, head_n, head_at))
    met = met.groupBy("doc", c("first.doc").alias("head")).agg(F.count(F.lit(1)).alias("shared"), F.max(n).alias("n"), F.min(level_of(c("info")) % 4).alias("level"))
    met = met.where((c("shared") >= c("level")) & (100 * c("shared") >= STAR_PERCENT * c("n")))
    best = Window.partitionBy("doc").orderBy(F.desc("shared"), "head")
    stars = staged(met.withColumn("nth", F.row_number().over(best)).where("nth <= 2").select(c("doc").alias("a"), c("head").alias("b")))
    links = staged(verified(stars, texts))
    near = components(links)

    # Exact pass: what the star pass left apart. Shingles that two components share are numbered within each text: of those alone can a
    # crossing pair share any, so a shared one's number bounds how many they share before it, and places what may come after.
    rooted = staged(listed.drop("first").join(near.select(c("node").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc")))
    # Of each token that several components share, the one that holds most of its rows; counts are combined before they move.
    sizes = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    shared = staged(sizes.groupBy("token").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1").select("token", "main"))
    text_key = F.shiftleft(n, LEVEL_BITS) + level_of(c("info"))
    marked = staged(rooted.join(small(shared), "token").withColumn("text", text_key).withColumn("nth", F.row_number().over(Window.partitionBy("doc", "text").orderBy("info"))))
    # A token's rows of its main component meet only the others, and these each other once: a large component's rows never meet among themselves.
    x, y = (marked.select(c("main").alias(f"main_{s}"), *[c(k).alias(f"{k}_{s}") for k in ("token", "doc", "info", "text", "nth", "root")]) for s in "xy")
    n_x, n_y, at_x, at_y = n_of(c("info_x")), n_of(c("info_y")), at_of(c("info_x")), at_of(c("info_y"))
    once = (c("root_y") == c("main_y")) | (c("doc_x") < c("doc_y"))
    fits = once & (c("doc_x") != c("doc_y")) & (c("root_x") != c("root_y")) & sizes_fit(n_x, n_y) & reaches(F.least("nth_x", "nth_y"), n_x, at_x, n_y, at_y)
    crossing = x.where("root_x <> main_x").join(y, (c("token_x") == c("token_y")) & fits)
    # A pair may come out either way round: its smaller document is x from here on.
    sides = {s: F.struct(c(f"doc_{s}").alias("doc"), c(f"text_{s}").alias("text"), at.alias("at")) for s, at in (("x", at_x), ("y", at_y))}
    turned = crossing.select(F.when(c("doc_x") < c("doc_y"), sides["x"]).otherwise(sides["y"]).alias("x"), F.when(c("doc_x") < c("doc_y"), sides["y"]).otherwise(sides["x"]).alias("y"))
    enough = turned.groupBy(c("y.doc").alias("a"), c("x.doc").alias("b"), c("x.text").alias("text_x"), c("y.text").alias("text_y")).agg(F.count(F.lit(1)).alias("shared"), F.max("x.at").alias("at_x"), F.max("y.at").alias("at_y"))
    level = lambda k: c(k) % (1 << LEVEL_BITS) % 4
    size = lambda k: F.shiftright(k, LEVEL_BITS)
    enough = enough.where((c("shared") >= F.least(level("text_x"), level("text_y"))) & reaches(c("shared"), size("text_x"), c("at_x"), size("text_y"), c("at_y")))
    left = staged(enough.select("a", "b").distinct().join(stars, ["a", "b"], "left_anti"))
    more = verified(left, texts)

    whole = components(staged(links.unionByName(more).unionByName(same_id)))
    named = members.join(whole.select(F.col("node").alias("doc"), "root"), "doc", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "doc")).alias("root"))
    return rows.join(named, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def op4_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `documents`."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
