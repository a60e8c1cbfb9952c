"""Product codes of vectors: Lloyd's rounds with Elkan's bounds, one codebook for each part of the vector.

State lies in a written table, one row a vector: its whole numbers, and of each part the entry it is assigned to, an upper bound
of its distance from that entry, and a lower bound of its distance from every entry. A round

1. sums the parts of each entry, once within each task, then over tasks: 16 x 64 rows reach the driver, whatever the table;
2. moves entries, and shifts bounds by how far: upper ones up by the assigned entry's step, lower ones down by each entry's;
3. assigns again; the first time, without bounds, against all entries. An entry is left out where the upper bound is strictly below its lower bound or strictly below half its
   distance from the assigned one. The upper bound is made tight before any other distance is computed. What is left is
   compared by squared distances of whole numbers, so that ties fall to the lower index exactly.

Bounds are kept on the safe side: upper ones as 32-bit floats rounded up, lower ones as half a byte each, in steps of a 15th of the
widest distance between entries, rounded down (on the 10,256 test vectors 11 to 14 % of entries stay open with these, 7 to 10 % with whole bytes). Entries that were left out get d(assigned, entry) - upper as lower bound where that is more.

Defined cases: vectors that are null or hold a null or non-finite component are dropped; empty and all-zero ones stay. Rows of null vec_id
come after all others; repeated rows count each. Whole numbers beyond +-2^26 are held to that. Vectors of each length have codebooks and a digest
of their own; part p of d components has those from floor(p * d / 16) on, so where d is below 16 some parts are empty (code 00, distance 0). With fewer than 64
vectors there are as many entries. Sums beyond 64 bits are held to the largest number. No rows give none.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordvane.llm.common import in_small_batches, staged

SCALE = 256
LARGEST = 2**26
PARTS = 16
ENTRIES = 64
ROUNDS = 2
SHARES = 64
#: Relative margin by which bounds are widened beyond what rounding can do.
MARGIN = 1e-9
LEVELS = 15
STATE = "vec_id long, label long, q array<int>, codes binary, upper binary, lower binary"


def whole_numbers(v: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as int."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))


def finite(v: Column) -> Column:
    """Whether v is a vector of finite components; an empty one is."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, q (whole numbers) of the rows that stay."""
    return embeddings.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole_numbers(F.col("embedding")).alias("q"))


def edges(dim: int, parts: int = PARTS) -> list[int]:
    return [p * dim // parts for p in range(parts + 1)]


class Codebook:
    """Entries of all parts for vectors of one length, (parts, entries, widest part); parts are filled up with zeros, which changes no distance."""

    def __init__(self, entries: np.ndarray, dim: int):
        self.entries, self.dim = entries, dim
        parts, n, _ = entries.shape
        apart = np.zeros((parts, n, n))
        for k in range(n):
            apart[:, k] = np.sqrt(((entries - entries[:, k : k + 1]) ** 2).sum(axis=2))
        #: Distances between entries, a little less than they are; how far apart the widest are.
        self.apart = apart * (1 - MARGIN)
        self.step = np.maximum(apart.max(axis=(1, 2)), 1.0) / LEVELS

    @classmethod
    def start(cls, rows: np.ndarray, parts: int = PARTS) -> Codebook:
        return cls(split(rows, parts).transpose(1, 0, 2).copy(), rows.shape[1])

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebook:
        """Entries at the floors of their parts' means; unused ones stay."""
        entries = self.entries.copy()
        for (part, entry), (count, total) in sums.items():
            entries[part, entry] = [x // count for x in total]
        return Codebook(entries, self.dim)

    def digest(self) -> str:
        cut = edges(self.dim, len(self.entries))
        numbers = [str(x) for p, entries in enumerate(self.entries) for e in entries for x in e[: cut[p + 1] - cut[p]]]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def split(rows: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """(rows, parts, widest part) of (rows, components)."""
    cut = edges(rows.shape[1], parts)
    out = np.zeros((len(rows), parts, max(1, max(b - a for a, b in zip(cut, cut[1:], strict=False)))), np.int64)
    for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        out[:, p, : b - a] = rows[:, a:b]
    return out


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=-1)


def first_assigned(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """assigned() where no bounds hold yet: every distance is found, and they are the bounds."""
    far = squares(x[:, :, None, :], book.entries[None])
    codes = far.argmin(axis=2)
    best = np.take_along_axis(far, codes[:, :, None], axis=2)[:, :, 0]
    return codes, best, np.sqrt(best) * (1 + MARGIN), np.sqrt(far) * (1 - MARGIN)


def assigned(x: np.ndarray, book: Codebook, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, squared distances, upper, lower) of parts x (rows, parts, width) from the bounds that hold before: the nearest entries, ties to the lower index.

    The squared distance is exact for every part; that of a part which no bound leaves open is found at the end only.
    """
    n, parts, _ = x.shape
    every = np.arange(parts)
    half = book.apart / 2
    apart = half[every, codes]  # (rows, parts, entries): half the distance from the assigned entry
    open_ = (upper[:, :, None] >= lower) & (upper[:, :, None] >= apart)
    np.put_along_axis(open_, codes[:, :, None], False, axis=2)
    some = open_.any(axis=2)
    best = np.full((n, parts), -1, np.int64)
    r, p = np.nonzero(some)
    best[r, p] = squares(x[r, p], book.entries[p, codes[r, p]])
    tight = upper.copy()
    tight[r, p] = np.sqrt(best[r, p]) * (1 + MARGIN)
    # With the bound made tight, fewer entries stay open.
    open_ &= (tight[:, :, None] >= lower) & (tight[:, :, None] >= apart)
    r, p, k = np.nonzero(open_)
    far = squares(x[r, p], book.entries[p, k])
    new_lower = np.maximum(lower, 2 * apart - tight[:, :, None])
    new_lower[r, p, k] = np.sqrt(far) * (1 - MARGIN)
    r0, p0 = np.nonzero(best >= 0)
    new_lower[r0, p0, codes[r0, p0]] = np.sqrt(best[r0, p0]) * (1 - MARGIN)
    # The least (distance, index) of the assigned entry and the open ones, in whole numbers.
    spot = r * parts + p
    order = np.lexsort((k, far, spot))
    first = np.r_[True, spot[order][1:] != spot[order][:-1]] if len(order) else np.zeros(0, bool)
    order = order[first]
    r, p, k, far = r[order], p[order], k[order], far[order]
    held, held_far = codes[r, p], best[r, p]
    better = (far < held_far) | ((far == held_far) & (k < held))
    new_codes = codes.copy()
    new_codes[r[better], p[better]] = k[better]
    best[r[better], p[better]] = far[better]
    tight[r[better], p[better]] = np.sqrt(far[better]) * (1 + MARGIN)
    r, p = np.nonzero(best < 0)
    best[r, p] = squares(x[r, p], book.entries[p, new_codes[r, p]])
    return new_codes, best, tight, np.maximum(new_lower, 0)


def shifted(codes: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: Codebook, after: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that hold after the entries have moved."""
    step = np.sqrt(squares(before.entries, after.entries)) * (1 + MARGIN)
    return upper + step[np.arange(len(step)), codes], np.maximum(lower - step, 0)


def pack_bounds(upper: np.ndarray, lower: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds as floats, lower ones two to a byte."""
    steps = np.minimum(np.floor(lower / book.step[:, None]), LEVELS).astype(np.uint8)
    if steps.shape[2] % 2:
        steps = np.concatenate([steps, np.zeros((*steps.shape[:2], 1), np.uint8)], axis=2)
    return np.nextafter(upper.astype(np.float32), np.float32(np.inf)), steps[:, :, ::2] | steps[:, :, 1::2] << 4


def unpack_bounds(upper: np.ndarray, lower: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    steps = np.stack([lower & 15, lower >> 4], axis=3).reshape(*lower.shape[:2], -1)[:, :, : book.entries.shape[1]]
    return upper.astype(np.float64), steps * (book.step[:, None] * (1 - MARGIN))


def by_length(batch):
    """(length, rows) of an Arrow batch with a column q, one for each length of q."""
    import pyarrow as pa

    lengths = batch.column("q").value_lengths().to_numpy()
    for dim in np.unique(lengths):
        yield int(dim), batch.take(pa.array(np.flatnonzero(lengths == dim)))


def matrix(batch, column: str, dtype: str, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype).reshape(batch.num_rows, *shape)


def binary(rows: np.ndarray):
    import pyarrow as pa

    return pa.array([r.tobytes() for r in rows], pa.binary())


def parts_of(batch, dim: int, parts: int) -> np.ndarray:
    return split(batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, dim), parts)


def first_state(vectors: DataFrame, books: dict[int, Codebook]) -> DataFrame:
    """Every part assigned without bounds."""

    def run(batches):
        for batch in batches:
            for dim, part in by_length(batch):
                book = books[dim]
                yield state_rows(part, book, *first_assigned(parts_of(part, dim, len(book.entries)), book))

    return in_small_batches(vectors).mapInArrow(run, STATE)


def state_rows(part, book: Codebook, codes, _, upper, lower):
    import pyarrow as pa

    up, low = pack_bounds(upper, lower, book)
    columns = [part.column("vec_id"), part.column("label"), part.column("q"), binary(codes.astype(np.uint8)), binary(up), binary(low)]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "q", "codes", "upper", "lower"])


def reassigned(part, dim: int, before: Codebook, after: Codebook):
    """assigned() of a batch of the state, its bounds shifted by the entries' movement."""
    parts, entries, _ = after.entries.shape
    codes = matrix(part, "codes", "u1", (parts,)).astype(np.int64)
    upper, lower = unpack_bounds(matrix(part, "upper", "<f4", (parts,)), matrix(part, "lower", "u1", (parts, (entries + 1) // 2)), before)
    return assigned(parts_of(part, dim, parts), after, codes, *shifted(codes, upper, lower, before, after))


def next_state(state: DataFrame, before: dict[int, Codebook], after: dict[int, Codebook]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for dim, part in by_length(batch):
                yield state_rows(part, after[dim], *reassigned(part, dim, before[dim], after[dim]))

    return in_small_batches(state).mapInArrow(run, STATE)


def coded(state: DataFrame, before: dict[int, Codebook], after: dict[int, Codebook]) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 after the last assignment."""
    digest = {dim: book.digest() for dim, book in after.items()}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for dim, part in by_length(batch):
                codes, far, _, _ = reassigned(part, dim, before[dim], after[dim])
                columns = [part.column("vec_id"), part.column("label"), pa.array([r.tobytes().hex() for r in codes.astype(np.uint8)]), pa.array(far.sum(axis=1)), pa.array([digest[dim]] * len(codes))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return in_small_batches(state).mapInArrow(run, "vec_id long, label long, code string, error long, codebooks_sha256 string")


def sums(state: DataFrame, parts: int = PARTS) -> dict[int, dict[tuple[int, int], tuple[int, list[int]]]]:
    """Of each vector length, part and entry in use: (count, componentwise sum). Added up within each task first."""

    def run(batches):
        import pyarrow as pa

        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, part in by_length(batch):
                x, codes = parts_of(part, dim, parts), matrix(part, "codes", "u1", (parts,)).astype(np.int64)
                count, total = held.setdefault(dim, (np.zeros((parts, ENTRIES), np.int64), np.zeros((parts, ENTRIES, x.shape[2]), np.int64)))
                for p in range(parts):
                    np.add.at(count[p], codes[:, p], 1)
                    np.add.at(total[p], codes[:, p], x[:, p])
        for dim, (count, total) in held.items():
            p, k = np.nonzero(count)
            columns = [pa.array(np.full(len(p), dim), pa.int32()), pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(count[p, k]), pa.array(list(total[p, k]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "part", "entry", "times", "total"])

    partial = in_small_batches(state).select("q", "codes").mapInArrow(run, "dim int, part int, entry int, times long, total array<long>")
    flat = partial.select("dim", "part", "entry", "times", F.posexplode("total").alias("at", "x"))
    found = flat.groupBy("dim", "part", "entry", "at").agg(F.sum("times").alias("times"), F.sum("x").alias("x")).groupBy("dim", "part", "entry").agg(F.first("times").alias("times"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("total"))
    out: dict[int, dict[tuple[int, int], tuple[int, list[int]]]] = {}
    for r in found.collect():  # ENTRIES rows for each part
        out.setdefault(r["dim"], {})[r["part"], r["entry"]] = (r["times"], [x["x"] for x in r["total"]])
    return out


def with_group_sum(rows: DataFrame, key: str, value: str, out: str, most: int = 1_000_000) -> DataFrame:
    """rows with `out`: the sum of value over rows of the same key, nulls together. A hot key's sum goes to several shares of its rows."""
    total = F.greatest(F.least(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")), F.lit(-(2**63)).cast("decimal(38,0)")).cast("long")
    totals = staged(rows.groupBy(F.col(key).alias("_k")).agg(total.alias(out)))
    if totals.count() <= most:
        return rows.join(F.broadcast(totals), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    dealt = totals.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    mine = rows.withColumn("_mine", F.pmod(F.xxhash64("vec_id"), F.lit(SHARES)).cast("int"))
    return mine.join(dealt, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_mine") == F.col("_share")), "left").drop("_k", "_share", "_mine")


def first_books(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> dict[int, Codebook]:
    """Of each vector length the codebook that starts from the smallest ids: entries rows a length, found with a limit in every task before the shuffle."""
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "q")
    rows = vectors.withColumn("dim", F.size("q")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= entries).select("dim", "nth", "q").collect()
    found: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["dim"], r["nth"])):
        found.setdefault(r["dim"], []).append(r["q"])
    return {dim: Codebook.start(np.array(q, np.int64).reshape(len(q), dim), parts) for dim, q in found.items()}


def compressed(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of vectors (vec_id, label, q)."""
    clean = staged(vectors)
    before = first_books(clean)
    state = staged(first_state(clean, before), codec="zstd")
    for k in range(rounds):
        total = sums(state)
        after = {dim: book.moved(total.get(dim, {})) for dim, book in before.items()}
        if k < rounds - 1:
            state = staged(next_state(state, before, after), codec="zstd")
            before = after
    return coded(state, before, after)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the vectors of `embeddings` that are whole."""
    rows = staged(compressed(kept_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))))
    return with_group_sum(rows, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op11_sql() -> str:
    """Two rounds of plain Lloyd and the last assignment, every part against every entry."""
    near = """near{k} as (select a.row, a.d, a.p, a.v, min(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0)::hugeint * 64 + b.k) as best
 from part a join book{k} b on a.d = b.d and a.p = b.p group by all)"""
    move = """flat{n} as (select d, p, (best % 64)::int as k, unnest(v) as x, generate_subscripts(v, 1) as i from near{k}),
sum{n} as (select d, p, k, i, sum(x) as s, count(*) as n from flat{n} group by all),
mean{n} as (select d, p, k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as v from sum{n} group by all),
book{n} as (select b.d, b.p, b.k, coalesce(m.v, b.v) as v from book{k} b left join mean{n} m on b.d = m.d and b.p = m.p and b.k = m.k)"""
    steps = ",\n".join(near.format(k=k) + (",\n" + move.format(k=k, n=k + 1) if k < ROUNDS else "") for k in range(ROUNDS + 1))
    return f"""
with w as (select vec_id, label, list_transform(embedding, lambda x: floor(greatest(least({SCALE} * x::double, {LARGEST}), {-LARGEST}))::bigint) as q from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
r as (select *, len(q)::bigint as d, row_number() over (order by vec_id nulls last, q) as row from w),
part as (select row, d, p, q[1 + p * d // {PARTS} : (p + 1) * d // {PARTS}] as v from r, range(0, {PARTS}) t(p)),
nth as (select row, row_number() over (partition by d order by row) - 1 as k from r),
book0 as (select d, p, k, v from part join nth using (row) where k < {ENTRIES}),
{steps},
number as (select d, p, k, unnest(v) as x, generate_subscripts(v, 1) as i from book{ROUNDS}),
lists as (select d, string_agg(x::varchar, ',' order by p, k, i) as list from number group by d),
sha as (select d, sha256(coalesce(list, '')) as codebooks_sha256 from (select distinct d from nth join r using (row)) left join lists using (d)),
code as (select row, string_agg(printf('%02x', (best % 64)::int), '' order by p) as code, sum(best // 64)::bigint as error from near{ROUNDS} group by row)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from r join code using (row) join sha using (d)
"""
