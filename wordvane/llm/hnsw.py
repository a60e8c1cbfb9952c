"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by hash of their id, SHARD_ROWS to a shard on average, so that no task's memory grows with the
table. Each shard's graph is built in one task: identical vectors are one node, vectors get one more component that makes
all norms of the shard equal (largest inner product is then nearest neighbour), nodes are inserted in batches, and every
layer's neighbours are one flat array. Index rows are a written table. Queries are shipped to every shard, in blocks of QUERY_ROWS that bound a
task's time, and go through it in batches; shard results are merged by a window over 20 rows per query and shard.

Recall depends on EF and DEGREE; op3 is measured against brute force in the tests. Every shard is searched with the same EF, though it holds only its share
of a query's nearest: what a narrow search misses in one shard no other makes good. Scores are exact, in double precision, on the original vectors.

Defined cases: vectors that are null, empty, all zero, or hold a null or non-finite component take no part, neither as queries
nor as candidates; vectors of another length than a query's aren't its candidates. Ties go to the smaller id. Of
identical vectors in a shard the TOP + 1 smallest ids are kept, which is all that can ever be reported. Rows of one id with
different vectors are candidates each. No rows give none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordvane.llm.common import BROADCAST_ROWS, meet, paired, staged

SHARD_ROWS = 16_384
DEGREE = 16
EF_BUILD = 64
EF = 200
TOP = 20
QUERY_ROWS = 16_384
INSERT_ROWS = 512


def usable(vector: Column, zero: bool = False) -> Column:
    """Whether a vector takes part; zero: all-zero ones do too."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.lit(True) if zero else F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & some, F.lit(False))


def select_diverse(ids: np.ndarray, sims: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) those nearer to the node than to any chosen before, at most `most`; the best of
    the rest fill up. Rows are handled together."""
    n, width = ids.shape
    inner = np.einsum("nid,njd->nij", vectors[ids], vectors[ids], optimize=True)
    chosen = np.zeros((n, width), bool)
    worst = np.full((n, width), -np.inf, np.float32)  # nearest chosen one, for each candidate
    count = np.zeros(n, int)
    for j in range(width):
        good = (ids[:, j] >= 0) & (count < most) & (sims[:, j] > worst[:, j])
        chosen[:, j] = good
        count += good
        worst = np.where(good[:, None], np.maximum(worst, inner[:, j, :]), worst)
    rank = np.where(ids < 0, 2 * width, np.where(chosen, 0, width)) + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :most]
    return np.take_along_axis(ids, order, axis=1)


def beam(vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step: (ids, similarities), best first, -1 where fewer than ef were met."""
    n = len(queries)
    ef = min(ef, len(vectors))
    seen = np.zeros((n, len(vectors) + 1), bool)  # the last column takes the -1 of absent neighbours
    seen[:, -1] = True
    every = np.arange(n)
    ids = np.full((n, ef), -1, np.int64)
    sims = np.full((n, ef), -np.inf, np.float32)
    done = np.ones((n, ef), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("nd,nd->n", queries, vectors[entry]), False
    seen[every, entry] = True
    active = every
    while len(active):
        a_sims = np.where(done[active], -np.inf, sims[active])
        best = a_sims.argmax(axis=1)
        go = a_sims[np.arange(len(active)), best] > -np.inf
        active, best = active[go], best[go]
        if not len(active):
            break
        done[active, best] = True
        near = graph[ids[active, best]]
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        new_sims = np.where(fresh, np.einsum("nkd,nd->nk", vectors[near], queries[active]), -np.inf).astype(np.float32)
        all_sims = np.concatenate([sims[active], new_sims], axis=1)
        keep = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        sims[active] = np.take_along_axis(all_sims, keep, axis=1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1), keep, axis=1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), keep, axis=1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def build_layer(vectors: np.ndarray, degree: int, ef: int, above: list[np.ndarray]) -> np.ndarray:
    """Flat neighbour array of one layer over all given vectors, in order: row i holds the neighbours of node i, -1 where fewer.

    above: the layers over this one, the highest first; each is over the first so many nodes. A node's search starts where the descent through them ends.
    """
    n = len(vectors)
    graph = np.full((n, degree), -1, np.int64)
    first = min(n, 2 * degree)
    linked = 0
    while linked < n:
        size = first if linked == 0 else min(INSERT_ROWS, linked, n - linked)
        new = np.arange(linked, linked + size)
        width = min(ef, max(1, linked + size - 1))
        inside = vectors[new] @ vectors[new].T
        np.fill_diagonal(inside, -np.inf)
        found_ids, found_sims = (np.broadcast_to(new, (size, size)), inside)
        if linked:
            start = descend(vectors, above, vectors[new]) if above and linked >= len(above[-1]) else np.zeros(size, int)
            ids, sims = beam(vectors[:linked], graph[:linked], vectors[new], start, ef)
            found_ids, found_sims = np.concatenate([ids, found_ids], axis=1), np.concatenate([sims, inside], axis=1)
        order = np.argsort(-found_sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(found_ids, order, axis=1), np.take_along_axis(found_sims, order, axis=1)
        ids = np.where(np.isfinite(sims), ids, -1)
        chosen = select_diverse(ids, sims, vectors, degree // 2 if linked else degree)
        graph[new, : chosen.shape[1]] = chosen
        # the way back: each chosen node gets the new one too, and is thinned out where it has too many
        target, source = chosen.ravel(), np.repeat(new, chosen.shape[1])
        ok = target >= 0
        target, source = target[ok], source[ok]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(nodes), int(counts.max()) if len(nodes) else 0), -1, np.int64)
        slot = np.arange(len(target)) - np.repeat(starts, counts)
        extra[np.repeat(np.arange(len(nodes)), counts), slot] = source
        merged = np.concatenate([graph[nodes], extra], axis=1)
        linked += size
        for at in range(0, len(nodes), 256):
            some, m = nodes[at : at + 256], np.sort(merged[at : at + 256], axis=1)
            m[:, 1:][m[:, 1:] == m[:, :-1]] = -1  # a pair that chose each other is one link
            s = np.where(m >= 0, np.einsum("nkd,nd->nk", vectors[m], vectors[some]), -np.inf).astype(np.float32)
            order = np.argsort(-s, axis=1, kind="stable")[:, : 4 * degree]
            m, s = np.take_along_axis(m, order, axis=1), np.take_along_axis(s, order, axis=1)
            kept = select_diverse(m, s, vectors, degree)
            graph[some] = -1
            graph[some, : kept.shape[1]] = kept
    return graph


def descend(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """The node nearest to each query in the lowest of the layers, by way of those above it; node 0 is where it starts."""
    at = np.zeros(len(queries), int)
    for graph in layers:
        at = beam(vectors[: len(graph)], graph, queries, at, 4)[0][:, 0]
    return at


class Graph:
    """layers: flat neighbours, the highest first, the last over all nodes; each is over the first so many nodes."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray, degree: int = DEGREE, ef: int = EF_BUILD) -> Graph:
        """A node is on layer 1 with a chance of 1 / degree, on layer 2 with that of its square, and so on, by a fixed generator; vectors come in
        mixed order, so that the first ones may be those of the highest layers."""
        rng = np.random.default_rng(11)
        level = np.floor(-np.log(1 - rng.random(len(vectors))) / np.log(degree)).astype(int)
        layers: list[np.ndarray] = []
        for k in range(int(level.max(initial=0)), -1, -1):
            n = int((level >= k).sum())
            layers.append(build_layer(vectors[:n], degree if k else 2 * degree, ef, layers))
        return cls(vectors, layers)

    def search(self, queries: np.ndarray, ef: int = EF) -> np.ndarray:
        """Node numbers near each query, best first, -1 for none."""
        return beam(self.vectors, self.layers[-1], queries, descend(self.vectors, self.layers[:-1], queries), ef)[0]


def may_be_reported(owner: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Of rows in order of (owner, id), those among the first `top` of their owner once all rows of some other id, the query's own, are left out."""
    sizes = np.bincount(owner)
    begin = np.cumsum(sizes) - sizes
    nth = np.arange(len(owner)) - begin[owner]
    keep = nth < top
    for k in np.flatnonzero(sizes > top):
        part = ids[begin[k] : begin[k] + sizes[k]]
        _, first, times = np.unique(part, return_index=True, return_counts=True)
        most = np.concatenate([[0], np.maximum.accumulate(times)[:-1]])  # rows of one id that come before, at most
        keep[begin[k] : begin[k] + sizes[k]] |= np.arange(sizes[k]) - np.repeat(most, times) < top
    return keep


INDEX_SCHEMA = "shard int, dim int, ids binary, owner binary, vectors binary, sizes array<int>, neighbours binary, degree int"


def shard_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, top: int = TOP) -> DataFrame:
    """One index row per shard and vector length, from (vec_id, v array<double>)."""
    n = vectors.count()
    shards = max(1, -(-n // shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("dim", F.size("v"))

    def build(key, frame):
        import pandas as pd

        ids, raw = frame["vec_id"].to_numpy(np.int64), np.stack(frame["v"].to_numpy()).astype(np.float64)
        order = np.argsort(ids, kind="stable")
        ids, raw = ids[order], raw[order]
        nodes, owner = np.unique(raw, axis=0, return_inverse=True)
        owner = owner.ravel()
        by = np.lexsort((ids, owner))
        by = by[may_be_reported(owner[by], ids[by], top)]
        mix = np.random.default_rng(5).permutation(len(nodes))  # np.unique sorts; graphs like a mixed order
        place = np.empty_like(mix)
        place[mix] = np.arange(len(mix))
        nodes = nodes[mix]
        graph = Graph.build(level_norms(nodes))
        flat = np.concatenate([g.ravel() for g in graph.layers]).astype("<i4")
        return pd.DataFrame([{
            "shard": key[0], "dim": key[1], "ids": ids[by].astype("<i8").tobytes(), "owner": place[owner[by]].astype("<i4").tobytes(), "vectors": nodes.astype("<f8").tobytes(),
            "sizes": [len(g) for g in graph.layers], "neighbours": flat.tobytes(), "degree": DEGREE,
        }])

    return dealt.groupBy("shard", "dim").applyInPandas(build, INDEX_SCHEMA)


def level_norms(nodes: np.ndarray) -> np.ndarray:
    """Vectors of norm 1 after scaling all by the largest norm, with one more component that fills each up."""
    nodes = nodes / (np.abs(nodes).max(initial=0.0) or 1.0)  # squares of very large components would be infinite
    square = np.einsum("nd,nd->n", nodes, nodes)
    most = square.max(initial=0.0) or 1.0
    return np.concatenate([nodes / np.sqrt(most), np.sqrt(np.maximum(0, 1 - square / most))[:, None]], axis=1).astype(np.float32)


def read_graph(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    """(ids in order of their nodes, where each node's begin and end, original vectors, graph) of an index row."""
    vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
    flat = np.frombuffer(row["neighbours"], "<i4").astype(np.int64)
    layers, cut, sizes = [], 0, list(row["sizes"])
    for k, size in enumerate(sizes):
        width = row["degree"] * (2 if k == len(sizes) - 1 else 1)
        layers.append(flat[cut : cut + size * width].reshape(size, width))
        cut += size * width
    ids, owner = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["owner"], "<i4")
    by = np.lexsort((ids, owner))
    return ids[by], np.searchsorted(owner[by], np.arange(len(vectors) + 1)), vectors, Graph(level_norms(vectors), layers)


def search(vectors: DataFrame, is_query: Column, top: int = TOP, ef: int = EF, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each query among all vectors but those of its own id. vectors: vec_id, v."""
    clean = staged(vectors)
    index = staged(shard_index(clean, shard_rows, top))
    # Repeated query rows are searched once; different vectors of one id are queries each.
    queries = staged(clean.where(is_query).dropDuplicates(["vec_id", "v"]).withColumn("query_no", F.monotonically_increasing_id())).withColumn("dim", F.size("v"))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    shards = staged(index.select("shard", "dim"))  # two numbers per shard_rows vectors
    # Each query block meets each shard of its dimension: queries are a stated set, against all rows, in blocks.
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).select("dim", "block", "query_no", "vec_id", "v")
    dealt = paired(dealt, shards, ["dim"], most=BROADCAST_ROWS).select("shard", "dim", "block", "query_no", "vec_id", "v")
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def look(loaded, batch):
        import pyarrow as pa

        ids, begin, nodes, net = loaded
        numbers, q_ids = (batch.column(c).to_numpy() for c in ("query_no", "vec_id"))
        q = batch.column("v").flatten().to_numpy().reshape(len(q_ids), -1)
        even = q / np.abs(q).max(axis=1, keepdims=True)  # not all zero
        flat = np.concatenate([even / np.sqrt((even * even).sum(axis=1, keepdims=True)), np.zeros((len(q), 1))], axis=1).astype(np.float32)
        found = net.search(flat, ef)
        which, near_ids, scores = [], [], []
        for i in range(len(q)):
            near = found[i][found[i] >= 0]
            n = begin[near + 1] - begin[near]
            members = np.repeat(begin[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            s, v = np.repeat((nodes[near] * q[i]).sum(axis=1), n), ids[members]
            other = v != q_ids[i]
            s, v = s[other], v[other]
            best = np.lexsort((v, -s))[:top]
            which.append(np.full(len(best), i))
            near_ids.append(v[best])
            scores.append(s[best])
        which = np.concatenate(which)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (numbers[which], q_ids[which], np.concatenate(near_ids), np.concatenate(scores))], names=["query_no", "query_id", "vec_id", "score"])

    met = meet(graphs, dealt, ["shard", "dim", "block"], lambda rows: read_graph(rows[0]), look, "query_no long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def as_vectors(embeddings: DataFrame, zero: bool = False) -> DataFrame:
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"), zero))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest found of every row of `embeddings` whose vec_id is divisible by 20."""
    return search(as_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % 20 == 0)
