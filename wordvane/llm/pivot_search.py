"""Exact top-k by integer inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it; vectors of a pivot and a ring of distances make blocks of at
most about BLOCK_ROWS rows, which carry the least and greatest distance and the greatest norm. For a query at distance d from
the pivot, the triangle inequality puts every vector of a block at least max(least - d, d - greatest, 0) away, and

    2 * q.x = |q|^2 + |x|^2 - |q - x|^2,

so a block has an upper bound of its scores. A query takes blocks from the best bound on and stops at the first bound below
its k-th best score so far. The k-th best score over the pivots' sample, which is part of the candidates, is where it starts.

Index blocks are a written table. They are bundled for tasks by pivot and, within one, by even shares. Each query's start and its
distances from the pivots are found once; bundles whose bound is below its start are left out before anything is shipped, and queries go to the
bundles that are left, in blocks of QUERY_ROWS. A window over k rows per query and bundle merges. The sample that pivots come from is the
only thing collected: at most SAMPLE rows.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; all-zero ones do. Vectors of
another length than a query's aren't its candidates. Ties go to the smaller id. Scores that don't fit 64 bits are
held to the largest number that does. Rows of one id with different vectors are candidates each. A repeated query row is a query each, but their
candidates are ranked together: r copies of a query report about 10 / r different candidates, r times each. No rows give none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordvane.llm.common import BROADCAST_ROWS, in_small_batches, meet, paired, staged
from wordvane.llm.hnsw import as_vectors

SCALE = 1024.0
TOP = 10
PIVOTS = 16
RINGS = 16
SAMPLE = 2048
BLOCK_ROWS = 2048
BUNDLE_ROWS = 16_384
QUERY_ROWS = 16_384
BLOCK_SCHEMA = "dim int, pivot int, ring int, bundle int, least double, greatest double, norm2 double, ids binary, vectors binary"


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of every component, as double."""
    return np.floor(SCALE * vectors.astype(np.float64))


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; exact in double precision while no partial sum can pass 2^53, else by Python's integers."""
    if np.abs(vectors).max(initial=0.0) * np.abs(query).max(initial=0.0) * len(query) < 2.0**53:
        return (vectors @ query).astype(np.int64)
    q = [int(x) for x in query]
    return np.array([min(2**63 - 1, max(-(2**63), sum(int(a) * b for a, b in zip(row, q, strict=True)))) for row in vectors], np.int64)


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Farthest-first: each next pivot is the sample row farthest from those chosen."""
    chosen = [sample[0]]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < most and far.max() > 0:
        chosen.append(sample[far.argmax()])
        far = np.minimum(far, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.stack(chosen)


class Pivots:
    """Of each vector length met in the sample: pivots, ring width, and the sample itself. Lengths not met get one pivot, the origin."""

    def __init__(self, sample: list[tuple[int, list[float]]]):
        self.by_dim: dict[int, tuple[np.ndarray, float, np.ndarray, np.ndarray]] = {}
        for dim in {len(v) for _, v in sample}:
            rows = integers(np.array([v for _, v in sample if len(v) == dim]))
            ids = np.array([i for i, v in sample if len(v) == dim], np.int64)
            pivots = choose_pivots(rows)
            far = self.distances(rows, pivots).min(axis=1)
            self.by_dim[dim] = (pivots, max(float(far.max()) / RINGS, 1.0), rows, ids)

    @staticmethod
    def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((rows - p) ** 2).sum(axis=1)) for p in pivots], axis=1)

    def of(self, dim: int) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        return self.by_dim.get(dim) or (np.zeros((1, dim)), SCALE, np.zeros((0, dim)), np.zeros(0, np.int64))

    def starts(self, ids: np.ndarray, queries: np.ndarray, top: int) -> list[int | None]:
        """Of each query, the k-th best score over the sample without its own rows: a bound that the k-th best of all can't be below."""
        _, _, rows, held = self.of(queries.shape[1])
        out: list[int | None] = []
        for query_id, query in zip(ids, queries, strict=True):
            others = products(rows, query)[held != query_id]
            out.append(None if len(others) < top else int(np.partition(others, -top)[-top]))
        return out


def prepared(queries: DataFrame, pivots: Pivots, top: int) -> DataFrame:
    """query_id, q (whole numbers), dim, square (of its norm), start, away (its distance from each pivot)."""

    def run(batches):
        import pyarrow as pa

        names = ["query_id", "q", "dim", "square", "start", "away"]
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy()
            for dim in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                ids, q = part.column("vec_id").to_numpy(), integers(part.column("v").flatten().to_numpy()).reshape(-1, dim)
                away = Pivots.distances(q, pivots.of(int(dim))[0])
                listed = lambda x: pa.array(list(x), pa.list_(pa.float64()))
                columns = [pa.array(ids), listed(q), pa.array(np.full(len(ids), dim), pa.int32()), pa.array((q * q).sum(axis=1)), pa.array(pivots.starts(ids, q, top), pa.int64()), listed(away)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_small_batches(queries).select("vec_id", "v").mapInArrow(run, "query_id long, q array<double>, dim int, square double, start long, away array<double>")


def keyed(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    def key(frames):
        for f in frames:
            if not len(f):
                continue
            f = f.assign(dim=f["v"].map(len).astype("int32"))
            pivot, ring, distance = np.zeros(len(f), np.int32), np.zeros(len(f), np.int32), np.zeros(len(f))
            for dim in f["dim"].unique():
                at = np.flatnonzero(f["dim"] == dim)
                rows = integers(np.stack(f["v"].iloc[at].to_numpy()))
                centres, width, _, _ = pivots.of(int(dim))
                d = Pivots.distances(rows, centres)
                pivot[at], distance[at] = d.argmin(axis=1), d.min(axis=1)
                ring[at] = np.minimum(RINGS - 1, distance[at] // width)
            yield f.assign(pivot=pivot, ring=ring, distance=distance)[["vec_id", "v", "dim", "pivot", "ring", "distance"]]

    return vectors.mapInPandas(key, "vec_id long, v array<double>, dim int, pivot int, ring int, distance double")


def index_blocks(vectors: DataFrame, pivots: Pivots, block_rows: int = BLOCK_ROWS, bundle_rows: int = BUNDLE_ROWS) -> DataFrame:
    """The index: one row per block. Rings with many rows are dealt to as many blocks as they need, pivots to as many bundles."""
    rows = keyed(vectors, pivots)
    sizes = rows.groupBy("dim", "pivot", "ring").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy("dim", "pivot"))
    parts = sizes.select("dim", "pivot", "ring", F.ceil(F.col("n") / block_rows).cast("int").alias("parts"), F.ceil(whole / bundle_rows).cast("int").alias("bundles"))
    # at most PIVOTS * RINGS rows for each length of vectors
    dealt = rows.join(F.broadcast(parts), ["dim", "pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def block(key, f):
        import pandas as pd

        ids, w = f["vec_id"].to_numpy(np.int64), integers(np.stack(f["v"].to_numpy()))
        d = f["distance"].to_numpy()
        bundle = (key[2] * 31 + key[3]) % int(f["bundles"].iloc[0])
        return pd.DataFrame([{"dim": key[0], "pivot": key[1], "ring": key[2], "bundle": bundle, "least": d.min(), "greatest": d.max(), "norm2": (w * w).sum(axis=1).max(), "ids": ids.astype("<i8").tobytes(), "vectors": w.astype("<f8").tobytes()}])

    return dealt.groupBy("dim", "pivot", "ring", "part").applyInPandas(block, BLOCK_SCHEMA)


def best_of_blocks(query_id: int, query: np.ndarray, centre: np.ndarray, blocks: list[tuple], top: int, start: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the best in blocks (least, greatest, norm2, ids, vectors): annuli by upper bound, until none can matter."""
    d, q2 = float(np.sqrt(((query - centre) ** 2).sum())), float((query * query).sum())
    bounds = []
    for k, (least, greatest, norm2, _, _) in enumerate(blocks):
        away = max(least - d, d - greatest, 0.0)
        slack = 1.0 + 1e-9 * (q2 + norm2)
        bounds.append((min((q2 + norm2 - away * away) / 2, np.sqrt(q2 * norm2)) + slack, k))
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for bound, k in sorted(bounds, reverse=True):
        floor = start
        if len(scores) == top:
            floor = int(scores[-1]) if floor is None else max(floor, int(scores[-1]))
        if floor is not None and bound < floor:
            break
        _, _, _, new_ids, vectors = blocks[k]
        s = products(vectors, query)
        good = new_ids != query_id
        if floor is not None:
            good &= s >= floor
        ids, scores = np.concatenate([ids, new_ids[good]]), np.concatenate([scores, s[good]])
        order = np.lexsort((ids, -scores))[:top]
        ids, scores = ids[order], scores[order]
    return ids, scores


def search(vectors: DataFrame, is_query: Column, top: int = TOP, block_rows: int = BLOCK_ROWS, bundle_rows: int = BUNDLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: exactly the `top` best of each query among all vectors but those of its own id. vectors: vec_id, v."""
    clean = staged(vectors)
    sample = [(r["vec_id"], r["v"]) for r in clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    pivots = Pivots(sample)
    blocks = staged(index_blocks(clean, pivots, block_rows, bundle_rows))
    queries = staged(prepared(clean.where(is_query), pivots, top))
    shares = max(1, -(-queries.count() // QUERY_ROWS))
    bundles = staged(blocks.groupBy("dim", "pivot", "bundle").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.max("norm2").alias("norm2")))
    # Each query block meets each bundle of its dimension that may hold one of its best: queries are a stated set, against all rows, in blocks.
    c = F.col
    far = F.greatest(c("least") - F.element_at("away", c("pivot") + 1), F.element_at("away", c("pivot") + 1) - c("greatest"), F.lit(0.0))
    bound = F.least((c("square") + c("norm2") - far * far) / 2, F.sqrt(c("square") * c("norm2"))) + 1 + 1e-9 * (c("square") + c("norm2"))
    pairs = paired(queries, bundles, ["dim"], most=BROADCAST_ROWS).where(c("start").isNull() | (bound >= c("start").cast("double")))  # six numbers per bundle_rows vectors
    dealt = pairs.withColumn("share", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(shares)).cast("int")).select("dim", "pivot", "bundle", "share", "query_id", "q", "start")
    meets = blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select("dim", "pivot", "bundle", "share", "least", "greatest", "norm2", "ids", "vectors")

    def load(rows):
        centre = pivots.of(rows[0]["dim"])[0][rows[0]["pivot"]]
        return centre, [(r["least"], r["greatest"], r["norm2"], np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vectors"], "<f8").reshape(-1, r["dim"])) for r in rows]

    def look(loaded, batch):
        import pyarrow as pa

        centre, parts = loaded
        query_ids = batch.column("query_id").to_numpy()
        qs = batch.column("q").flatten().to_numpy().reshape(len(query_ids), -1)
        rows = []
        for query_id, q, start in zip(query_ids, qs, batch.column("start").to_pylist(), strict=True):
            ids, scores = best_of_blocks(int(query_id), q, centre, parts, top, start)
            rows.append((np.full(len(ids), query_id), ids, scores))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])

    met = meet(meets, dealt, ["dim", "pivot", "bundle", "share"], load, look, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: exactly the 10 best of every row of `embeddings` whose vec_id is divisible by 100."""
    return search(as_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), zero=True), F.col("vec_id") % 100 == 0)


OP7_SQL = """
with w as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) as v from embeddings
 where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
 from w q join w c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
