"""Hard negatives by a pivot table over vectors whose inner product is turned into a distance.

With M^2 the greatest squared norm of the table, a row x becomes (x, sqrt(M^2 - |x|^2)) and an anchor a becomes (a, 0), so that

    |a' - x'|^2 = |a|^2 + M^2 - 2 * a.x.

Each row's distances from PIVOTS rows of a sample are stored with it. For an anchor, whose distances from the pivots are found once, the triangle
inequality puts |a' - x'| between the greatest |d(a, p) - d(x, p)| and the least d(a, p) + d(x, p), and so brackets the score. Rows whose bracket
lies outside of what can still be reported are left out, survivors are checked exactly in whole numbers. The same brackets hold for a whole bundle
of rows by the least and greatest distance from each pivot; anchors aren't shipped to bundles that they leave out.

Two searches: the positives, in bundles of one label; then, of all bundles, rows of other labels between the bounds that each positive
score sets. Both start from what the sample, which is part of the candidates, already reaches. Anchors are a stated query set against all rows, in
blocks. Bundles have at most about BUNDLE_ROWS rows, so a frequent label or vector is many tasks; merges are windows over a few rows per anchor and
bundle. The sample is the only thing collected: at most SAMPLE rows.

Defined cases: rows with a null id or label, with a null or empty vector, or with a null or non-finite component take no part; all-zero
vectors do. Whole numbers beyond +-2^26 are held to that. Vectors of another length than an anchor's aren't its candidates, nor are rows of its own id.
Repeated anchor rows are mined once, rows of one id that differ are anchors each. Repeated candidates count each, so an id may be reported twice; a
positive that stands twice has its negatives twice. Labels' remainder by 10 has the label's sign. Positives of negative score have no negatives. No rows give none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordvane.llm.common import in_small_batches, meet, paired, staged
from wordvane.llm.pivot_search import choose_pivots, products
from wordvane.llm.vector_codes import finite, whole_numbers

POSITIVES = 5
NEGATIVES = 3
PIVOTS = 16
SAMPLE = 2048
BUNDLE_ROWS = (2_048, 16_384)  # least and most: between them, as many as give each core several bundles
QUERY_ROWS = 16_384
MOST_TASKS = 20_000
#: How far, in relation to the numbers they come from, brackets are widened beyond what rounding (distances are 32-bit floats) can do.
MARGIN = 1e-6


class Table:
    """Of each vector length: M^2, and the sample's ids, labels and rows; pivots are the rows of it that lie farthest apart."""

    def __init__(self, norms: dict[int, int], sample: list[tuple[int, int, list[int]]], most: int = PIVOTS):
        self.norms = {dim: float(n) for dim, n in norms.items()}
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for dim in norms:
            some = [r for r in sample if len(r[2]) == dim]
            rows = np.array([r[2] for r in some], np.float64).reshape(len(some), dim)
            pivots = choose_pivots(self.raised(rows), most) if len(rows) else np.zeros((1, dim + 1))
            self.by_dim[dim] = (pivots, np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], np.int64), rows)

    def raised(self, rows: np.ndarray) -> np.ndarray:
        """Rows with the component that brings all to one norm."""
        fill = np.sqrt(np.maximum(0.0, self.norms[rows.shape[1]] - (rows * rows).sum(axis=1)))
        return np.concatenate([rows, fill[:, None]], axis=1)

    def away(self, rows: np.ndarray, anchors: bool = False) -> np.ndarray:
        """Distances of rows from the pivots; anchors have 0 as the component more."""
        pivots = self.by_dim[rows.shape[1]][0]
        whole = np.concatenate([rows, np.zeros((len(rows), 1))], axis=1) if anchors else self.raised(rows)
        return np.stack([np.sqrt(((whole - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def window_of(positive: int) -> tuple[int, int]:
    """The scores s with 50 * positive <= 100 * s <= 95 * positive."""
    return -(-positive // 2), 19 * positive // 20


def kth_best(scores: np.ndarray, k: int) -> int | None:
    return None if len(scores) < k else int(np.partition(scores, -k)[-k])


def usable_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, q, square (|q|^2) of the rows that take part; the label of ids divisible by 7 moves on by one."""
    whole = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")) & (F.size("embedding") > 0))
    label = F.col("label").cast("long")
    rows = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole_numbers(F.col("embedding")).alias("q"))
    return rows.withColumn("square", F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long")))


def with_distances(rows: DataFrame, table: Table) -> DataFrame:
    """The pivot table: rows with dim and away."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lengths = batch.column("q").value_lengths().to_numpy()
            for dim in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                away = table.away(matrix(part, "q", int(dim)))
                columns = [*(part.column(c) for c in ("vec_id", "label", "q")), pa.array(np.full(len(away), dim), pa.int32()), pa.array(list(away.astype(np.float32)), pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "q", "dim", "away"])

    return in_small_batches(rows).select("vec_id", "label", "q").mapInArrow(run, "vec_id long, label long, q array<int>, dim int, away array<float>")


def matrix(batch, column: str, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)


def anchors_of(table_rows: DataFrame, is_anchor: Column, table: Table) -> DataFrame:
    """anchor, vec_id, label, q, dim, mine (distances from the pivots), start: a score that the last positive can't be below."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                q = matrix(part, "q", int(dim))
                _, ids, labels, rows = table.by_dim[int(dim)]
                starts = []
                for vec_id, label, x in zip(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), q, strict=True):
                    starts.append(kth_best(products(rows[(labels == label) & (ids != vec_id)], x), POSITIVES))
                columns = [*(part.column(c) for c in ("anchor", "vec_id", "label", "q", "dim")), pa.array(list(table.away(q, anchors=True)), pa.list_(pa.float64())), pa.array(starts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "vec_id", "label", "q", "dim", "mine", "start"])

    once = table_rows.where(is_anchor).select("vec_id", "label", "q", "dim").dropDuplicates().withColumn("anchor", F.monotonically_increasing_id())
    return in_small_batches(once).mapInArrow(run, "anchor long, vec_id long, label long, q array<int>, dim int, mine array<double>, start long")


def bundled(rows: DataFrame, keys: list[str], bundle_rows: int, most: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """rows with `bundle`, by the keys and even shares of each; and of each bundle the least and greatest distance from every pivot. Rows of
    a bundle have the same nearest pivot, so that its distances are alike, where there are enough of them."""
    nearest = F.array_position("away", F.array_min("away")).cast("int")
    placed = rows.withColumn("nearest", nearest)
    sizes = staged(placed.groupBy(*keys, "nearest").agg(F.count(F.lit(1)).alias("n")))
    # Pivots with few rows share a bundle: a running sum over at most PIVOTS rows of each key.
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("nearest")) - F.col("n")
    plan = sizes.select(*keys, "nearest", F.floor(before / bundle_rows).alias("group"), F.ceil(F.col("n") / bundle_rows).cast("int").alias("shares"))
    plan = staged(plan)
    if plan.count() <= most:
        met = placed.join(F.broadcast(plan), [*keys, "nearest"])
    else:
        # Only keys that fill a bundle are broadcast, at most rows / bundle_rows of them; no other has more rows than a bundle.
        large = placed.join(F.broadcast(plan.where("shares > 1")), [*keys, "nearest"], "left")
        met = large.where("shares is not null").unionByName(large.where("shares is null").drop("group", "shares").join(plan.where("shares = 1"), [*keys, "nearest"]))
    share = F.pmod(F.xxhash64("vec_id"), F.col("shares")).cast("int")
    dealt = staged(met.withColumn("bundle", F.xxhash64("group", F.when(F.col("shares") > 1, F.col("nearest")).otherwise(F.lit(0)), share)).select("vec_id", "label", "q", "dim", "away", "bundle"))
    flat = dealt.select(*keys, "bundle", F.posexplode("away").alias("at", "x")).groupBy(*keys, "bundle", "at").agg(F.min("x").alias("least"), F.max("x").alias("greatest"))
    ends = flat.groupBy(*keys, "bundle").agg(F.array_sort(F.collect_list(F.struct("at", "least", "greatest"))).alias("ends"))
    return dealt, staged(ends.select(*keys, "bundle", F.transform("ends", lambda e: e["least"]).alias("least"), F.transform("ends", lambda e: e["greatest"]).alias("greatest")))


def may_hold(table: Table, lowest: Column, highest: Column) -> Column:
    """Whether a bundle's bracket meets the scores from lowest (null: any) to highest (null: any)."""
    dims = F.create_map(*[F.lit(x) for dim, n in table.norms.items() for x in (dim, n)])
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) + dims[F.col("dim")]
    gaps = F.zip_with(F.zip_with("least", "mine", lambda a, b: a - b), F.zip_with("mine", "greatest", lambda a, b: a - b), lambda a, b: F.greatest(a, b))
    near, far = F.greatest(F.array_max(gaps), F.lit(0.0)), F.array_min(F.zip_with("greatest", "mine", lambda a, b: a + b))
    slack = 1 + MARGIN * square
    above = F.coalesce((square - near * near) / 2 + slack >= lowest.cast("double"), F.lit(True))
    return above & F.coalesce((square - far * far) / 2 - slack <= highest.cast("double"), F.lit(True))


def load(table: Table):
    """A bundle's rows as arrays: ids, labels, vectors, distances from the pivots."""

    def of(rows):
        q = np.array([r["q"] for r in rows], np.float64)
        away = np.array([r["away"] for r in rows], np.float32)
        return np.array([r["vec_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), q, away, float(np.abs(q).max(initial=0.0))

    return of


def exact(rows: np.ndarray, largest: float, anchor: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers: exact in double precision while no partial sum can pass 2^53."""
    small = largest * float(np.abs(anchor).max(initial=0.0)) * len(anchor) < 2.0**53
    return (rows @ anchor).astype(np.int64) if small else products(rows, anchor)


def survivors(loaded, table: Table, anchor: np.ndarray, mine: np.ndarray, allowed: np.ndarray, lowest: int | None, highest: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, exact scores) of the allowed rows whose bracket meets the scores from lowest to highest."""
    ids, _, q, away, largest = loaded
    square = float((anchor * anchor).sum()) + table.norms[len(anchor)]
    slack = 1 + MARGIN * square
    mine = mine.astype(np.float32)
    at = np.flatnonzero(allowed)
    if lowest is not None:
        # A row is no nearer than any of its distances from a pivot differs from the anchor's.
        near = np.abs(away[at] - mine).max(axis=1, initial=0).astype(np.float64)
        at = at[(square - near * near) / 2 + slack >= lowest]
    if highest is not None:
        far = (away[at] + mine).min(axis=1, initial=np.inf).astype(np.float64)
        at = at[(square - far * far) / 2 - slack <= highest]
    scores = exact(q[at], largest, anchor) if 2 * len(at) < len(ids) else exact(q, largest, anchor)[at]  # one product over all is cheaper than copying most rows
    ids = ids[at]
    good = np.ones(len(ids), bool)
    if lowest is not None:
        good &= scores >= lowest
    if highest is not None:
        good &= scores <= highest
    return ids[good], scores[good]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def in_bundles(rows: DataFrame, ends: DataFrame, anchors: DataFrame, keys: list[str], lowest: Column, highest: Column, look, schema: str, table: Table) -> DataFrame:
    """look() over each bundle that may hold a row for an anchor and the anchors it may hold one for, in blocks of QUERY_ROWS."""
    blocks = max(1, -(-anchors.count() // QUERY_ROWS))
    extra = [c for c in anchors.columns if c not in keys]
    pairs = paired(anchors, ends, keys).where(may_hold(table, lowest, highest))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")).select(*keys, "bundle", "block", *extra)
    index = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if "label" not in keys:
        dealt = dealt.withColumnRenamed("label", "own").withColumnRenamed("vec_id", "own_id").withColumnRenamed("q", "own_q")
    else:
        dealt = dealt.withColumn("own", F.col("label")).withColumnRenamed("vec_id", "own_id").withColumnRenamed("q", "own_q")
    return meet(index, dealt, [*keys, "bundle", "block"], load(table), look, schema, tasks=min(MOST_TASKS, max(1, ends.count() * blocks)))


def positives(rows: DataFrame, anchors: DataFrame, table: Table, bundle_rows: int, top: int = POSITIVES) -> DataFrame:
    """anchor, nth, positive_id, positive_score: the best rows of each anchor's own label."""
    dealt, ends = bundled(rows, ["dim", "label"], bundle_rows)

    def look(loaded, batch):
        import pyarrow as pa

        out = []
        dim = batch.column("dim")[0].as_py()
        own_q, mine = matrix(batch, "own_q", dim), matrix(batch, "mine", loaded[3].shape[1])
        for i, (anchor, own_id, start) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("anchor", "own_id", "start")), strict=True)):
            ids, scores = survivors(loaded, table, own_q[i], mine[i], loaded[0] != own_id, start, None)
            at = best(ids, scores, top)
            out.append((np.full(len(at), anchor), ids[at], scores[at]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["anchor", "positive_id", "positive_score"])

    met = in_bundles(dealt, ends, anchors, ["dim", "label"], F.col("start"), F.lit(None), look, "anchor long, positive_id long, positive_score long", table)
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    return met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top)


def with_floors(anchors: DataFrame, found: DataFrame, table: Table, top: int = NEGATIVES) -> DataFrame:
    """Anchors with their positives: scores, and floors (a score that the last negative of each can't be below), lowest and highest of interest."""
    lists = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("found"))  # at most POSITIVES
    both = anchors.drop("start").join(lists, "anchor").select("*", F.col("found.positive_id").alias("ids"), F.col("found.positive_score").alias("scores")).drop("found")
    columns = ["anchor", "vec_id", "label", "q", "dim", "mine", "ids", "scores"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                _, _, labels, rows = table.by_dim[int(dim)]
                ids = table.by_dim[int(dim)][1]
                floors, lowest, highest = [], [], []
                for own_id, own, x, scores in zip(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part, "q", int(dim)), part.column("scores").to_pylist(), strict=True):
                    s = products(rows[(labels != own) & (ids != own_id)], x)
                    mine = []
                    for positive in scores:
                        low, high = window_of(positive)
                        reached = kth_best(s[(s >= low) & (s <= high)], top)
                        mine.append(low if reached is None else reached)
                    floors.append(mine)
                    lowest.append(min(mine))
                    highest.append(max(window_of(p)[1] for p in scores))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(floors, pa.list_(pa.int64())), pa.array(lowest), pa.array(highest)], names=[*columns, "floors", "lowest", "highest"])

    schema = "anchor long, vec_id long, label long, q array<int>, dim int, mine array<double>, ids array<long>, scores array<long>, floors array<long>, lowest long, highest long"
    return in_small_batches(both.select(*columns)).mapInArrow(run, schema)


def negatives(rows: DataFrame, anchors: DataFrame, table: Table, bundle_rows: int, top: int = NEGATIVES) -> DataFrame:
    """anchor, nth, rank, negative_id, negative_score of anchors as with_floors() gives them."""
    dealt, ends = bundled(rows, ["dim"], bundle_rows)

    def look(loaded, batch):
        import pyarrow as pa

        out = [(np.zeros(0, np.int64),) * 4]
        dim = batch.column("dim")[0].as_py()
        own_q, mine = matrix(batch, "own_q", dim), matrix(batch, "mine", loaded[3].shape[1])
        for i, (anchor, own, own_id, scores, floors, lowest, highest) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("anchor", "own", "own_id", "scores", "floors", "lowest", "highest")), strict=True)):
            ids, s = survivors(loaded, table, own_q[i], mine[i], (loaded[1] != own) & (loaded[0] != own_id), lowest, highest)
            for nth, (positive, floor) in enumerate(zip(scores, floors, strict=True), 1):
                some = np.flatnonzero((s >= floor) & (s <= window_of(positive)[1]))
                at = some[best(ids[some], s[some], top)]
                out.append((np.full(len(at), anchor), np.full(len(at), nth), ids[at], s[at]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["anchor", "nth", "negative_id", "negative_score"])

    wanted = anchors.where(F.col("highest") >= F.col("lowest"))
    met = in_bundles(dealt, ends, wanted, ["dim"], F.col("lowest"), F.col("highest"), look, "anchor long, nth long, negative_id long, negative_score long", table)
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("negative_score"), "negative_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def mined(rows: DataFrame, is_anchor: Column, bundle_rows: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, q, square)."""
    clean = staged(rows)
    norms = {r["dim"]: r["most"] for r in clean.groupBy(F.size("q").alias("dim")).agg(F.max("square").alias("most")).collect()}  # one row a vector length
    table = Table(norms, [(r["vec_id"], r["label"], r["q"]) for r in clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "label", "q").collect()])
    if not norms:
        return clean.select(F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.lit(0).alias("rank"), F.col("vec_id").alias("negative_id"), F.col("square").alias("positive_score"), F.col("square").alias("negative_score"))
    whole = staged(with_distances(clean, table))
    if bundle_rows is None:
        bundle_rows = min(BUNDLE_ROWS[1], max(BUNDLE_ROWS[0], whole.count() // (4 * rows.sparkSession.sparkContext.defaultParallelism)))
    anchors = staged(anchors_of(whole, is_anchor, table))
    found = staged(positives(whole, anchors, table, bundle_rows))
    ready = staged(with_floors(anchors, found, table))
    met = negatives(whole, ready, table, bundle_rows)
    named = met.join(found, ["anchor", "nth"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: three hard negatives of each of five positives of every anchor of `embeddings`."""
    rows = usable_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
    return mined(rows, F.col("vec_id") % 50 == 0)


OP13_SQL = """
with w as (select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
 list_transform(embedding, lambda x: floor(greatest(least(256 * x::double, 67108864), -67108864))::bigint) as v from embeddings
 where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select *, row_number() over () as anchor from (select distinct * from w where vec_id % 50 = 0)),
s as (select a.anchor, a.vec_id as anchor_id, c.vec_id, a.label = c.label as alike, list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::bigint as score
 from a join w c on a.vec_id <> c.vec_id and len(a.v) = len(c.v)),
p as (select anchor, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor order by score desc, vec_id) as nth from s where alike qualify nth <= 5),
n as (select p.anchor_id, p.positive_id, p.positive_score, s.vec_id as negative_id, s.score as negative_score,
 row_number() over (partition by p.anchor, p.nth order by s.score desc, s.vec_id)::int as rank
 from p join s on p.anchor = s.anchor and not s.alike and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
