"""Vector codes, exact copies and hard negatives: against their SQL on planted edges, and against plain versions."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wordvane.llm import exact_dedup, hard_negatives, vector_codes
from wordvane.llm.common import paired, staged

NAN, INF = float("nan"), float("inf")


def rows_of(found, columns):
    return sorted(str(list(r)) for r in found.select(*columns).collect())


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"create view {name} as select * from '{path}'")
    found = con.execute(sql)
    return [d[0] for d in found.description], sorted(str(list(r)) for r in found.fetchall())


def embeddings(tmp_path, rows, extra=True):
    ids, vectors, labels = zip(*rows, strict=True) if rows else ((), (), ())
    columns = {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float64())), "label": pa.array(labels, pa.int32())}
    if extra:  # names that the operators use inside
        columns |= {"q": pa.array([1] * len(ids)), "dim": pa.array([2] * len(ids)), "_K": pa.array(["x"] * len(ids)), "codes": pa.array(["y"] * len(ids))}
    (tmp_path / "t").mkdir(exist_ok=True)
    pq.write_table(pa.table(columns), tmp_path / "t/embeddings.parquet")
    return f"{tmp_path}/t"


def awkward_vectors(seed=3, n=300):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(size=8) * rng.choice([0.01, 0.3, 3])], None if i % 11 == 0 else int(rng.integers(-3, 12))) for i in rng.permutation(n)]
    rows += [rows[4], rows[4], rows[9]]  # repeated rows
    rows += [(i, rows[5][1], 1) for i in range(1000, 1080)]  # one vector that many rows share
    rows += [(2000, None, 1), (2001, [1.0, None] * 4, 1), (2002, [NAN] * 8, 2), (2003, [INF] + [0.0] * 7, 2), (2004, [0.0] * 8, 1), (50, [0.0] * 8, 3), (2050, [0.0] * 8, 3)]
    rows += [(None, [0.5] * 8, 1), (2006, [1e300, -1e300, 3e38, 0, 0, 0, 0, 0], 4), (2100, [1e30] + [0.0] * 7, 4)]
    rows += [(3000 + i, [float(x) for x in rng.normal(size=5)], i % 3) for i in range(0, 120)]  # another length, below the number of parts
    rows += [(4000, [], 1), (4050, [], 1), (5000, [0.25], None)]
    return rows


@pytest.mark.parametrize("rows", [awkward_vectors(), awkward_vectors()[:3], []], ids=["awkward", "few", "none"])
def test_vectors_against_sql(spark, tmp_path, rows):
    at = embeddings(tmp_path, rows)
    for f, sql in ((vector_codes.op11_vector_codes, vector_codes.op11_sql()), (hard_negatives.op13_hard_negatives, hard_negatives.OP13_SQL)):
        columns, want = sql_rows(sql, embeddings=f"{at}/embeddings.parquet")
        assert rows_of(f(spark, at), columns) == want
        assert want or len(rows) < 4


def test_bounds_leave_out_and_stay_right():
    """Elkan's assignment against plain distances over rounds, with ties; from the second round on most entries are left out."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (64, 32))
    rows = np.concatenate([centres, centres[rng.integers(0, 64, 900)] + rng.integers(-6, 7, (900, 32)), rng.integers(-1, 2, (40, 32))])
    x = vector_codes.split(rows)
    book = vector_codes.Codebook.start(rows[:64])
    shares = []
    for k in range(4):
        codes, far, upper, lower = vector_codes.assigned(x, book, codes, upper, lower) if k else vector_codes.first_assigned(x, book)
        every = vector_codes.squares(x[:, :, None, :], book.entries[None])
        assert (codes == every.argmin(axis=2)).all() and (far == every.min(axis=2)).all()
        upper, lower = vector_codes.unpack_bounds(*vector_codes.pack_bounds(upper, lower, book), book)
        assert (upper**2 >= far).all() and (lower**2 <= every * (1 + 1e-6)).all()
        new = book.moved({(p, k): (int(m.sum()), x[m, p].sum(axis=0).tolist()) for p in range(16) for k in range(64) if (m := codes[:, p] == k).any()})
        upper, lower = vector_codes.shifted(codes, upper, lower, book, new)
        shares.append(float((upper[:, :, None] >= np.maximum(lower, new.apart[np.arange(16), codes] / 2)).mean()))
        book = new
    assert max(shares) < 0.3, shares


def test_codes_of_hot_label(spark):
    """Sums of labels beyond the broadcast: by shares, nulls together."""
    rows = spark.createDataFrame([(i, None if i % 3 else i % 2, i) for i in range(200)], "vec_id long, label long, error long")
    want = {None: sum(i for i in range(200) if i % 3), 0: sum(range(0, 200, 6)), 1: sum(range(3, 200, 6))}
    for most in (1_000_000, 0):
        found = vector_codes.with_group_sum(rows, "label", "error", "s", most).collect()
        assert len(found) == 200 and all(r["s"] == want[r["label"]] for r in found)


def documents(tmp_path, rows):
    ids, texts = zip(*rows, strict=True) if rows else ((), ())
    (tmp_path / "d").mkdir(exist_ok=True)
    columns = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "row": pa.array([0] * len(ids)), "N": pa.array([0] * len(ids)), "bits": pa.array([0] * len(ids)), "digest": pa.array(["d"] * len(ids))}
    pq.write_table(pa.table(columns), tmp_path / "d/documents.parquet")
    return f"{tmp_path}/d"


COPIES = [(i, f"text {i % 37}" + " " * (i % 5)) for i in range(400)] + [(1000 + i, "one and the same") for i in range(300)] + [
    (2000, None), (2001, ""), (2002, " \t\n\x0b\x0c\r"), (2003, "\xa0"), (2004, "a b"), (2005, "ab"), (2006, "a b"), (2007, "a\tb"), (2008, "\U0001f600 x"), (2009, "\U0001f600x"), (2010, "café"), (2011, "café"),
    (2006, "a b"), (2006, "a b"), (None, "a b"), (None, "alone"), (2012, "A b"), (2013, "word " * 200_000), (2014, "word" * 200_000),
]


@pytest.mark.parametrize("rows", [COPIES, COPIES[:1], []], ids=["copies", "one", "none"])
@pytest.mark.parametrize("settings", [{}, {"broadcast_blocks": 0, "heavy": 20}, {"broadcast_blocks": 1, "heavy": 20, "bits_a_row": 2000}], ids=str)
def test_copies_against_sql(spark, tmp_path, rows, settings):
    at = documents(tmp_path, rows)
    columns, want = sql_rows(exact_dedup.OP12_SQL, documents=f"{at}/documents.parquet")
    found = exact_dedup.deduplicated(spark.read.parquet(f"{at}/documents.parquet"), **settings)
    assert rows_of(found, columns) == want
    assert found.where("kept").count() == found.select("text_sha256").distinct().count()


def test_filter_passes_unique_rows(spark):
    """Every repeated row is among those that may be; of the others only a few are."""
    rows = exact_dedup.digests(spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") < 18_000, F.col("id")).otherwise(F.col("id") % 700)).alias("text")))
    blocks = 16
    after = exact_dedup.tested(rows, staged(exact_dedup.repeated_cells(rows, blocks)), blocks, 20_000)
    repeated = rows.groupBy("digest").count().where("count > 1").select("digest")
    assert after.join(repeated, "digest").where("not maybe").count() == 0
    assert after.join(repeated, "digest", "left_anti").where("maybe").count() < 17_300 * 0.03


def test_no_python_in_exact_dedup(spark, sf):
    plan = exact_dedup.op12_exact_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_brackets_hold_the_score():
    """Survivors are exactly the rows with a score between the bounds; few others have to be checked where vectors have few components."""
    rng = np.random.default_rng(2)
    rows = rng.integers(-300, 300, (400, 3)).astype(float)
    table = hard_negatives.Table({3: int((rows**2).sum(axis=1).max())}, [(i, 0, r.tolist()) for i, r in enumerate(rows[:100])])
    loaded = hard_negatives.load(table)([{"vec_id": i, "label": i % 2, "q": r.astype(int).tolist(), "away": a.tolist()} for i, (r, a) in enumerate(zip(rows, table.away(rows).astype(np.float32), strict=True))])
    checked, exact = [], hard_negatives.exact
    hard_negatives.exact = lambda part, *a: (checked.append(len(part)), exact(part, *a))[1]
    try:
        for a, m in zip(rows[:40], table.away(rows[:40], anchors=True), strict=True):
            scores = (rows @ a).astype(np.int64)
            for lowest, highest in ((int(np.sort(scores)[-6]), None), (int(np.sort(scores)[-40]), int(np.sort(scores)[-20])), (None, 0), (None, None)):
                ids, found = hard_negatives.survivors(loaded, table, a, m, loaded[1] == 0, lowest, highest)
                want = (loaded[1] == 0) & (scores >= (-(2**62) if lowest is None else lowest)) & (scores <= (2**62 if highest is None else highest))
                assert (ids == np.flatnonzero(want)).all() and (found == scores[want]).all()
    finally:
        hard_negatives.exact = exact
    assert np.mean(checked[::4]) < 100


def test_negatives_in_small_bundles(spark, tmp_path):
    """Many bundles to an anchor, summaries and plans beyond the broadcast: the same rows."""
    rng = np.random.default_rng(7)
    at = embeddings(tmp_path, [(i, [float(x) for x in rng.normal(size=6)], int(i % 50 == 1 or rng.integers(0, 3))) for i in range(1500)])
    columns, want = sql_rows(hard_negatives.OP13_SQL, embeddings=f"{at}/embeddings.parquet")
    rows = hard_negatives.usable_rows(spark.read.parquet(f"{at}/embeddings.parquet"))
    assert rows_of(hard_negatives.mined(rows, F.col("vec_id") % 50 == 0, bundle_rows=40), columns) == want and len(want) > 200
    held = hard_negatives.bundled.__defaults__
    hard_negatives.bundled.__defaults__ = (0,)
    try:
        assert rows_of(hard_negatives.mined(rows, F.col("vec_id") % 50 == 0, bundle_rows=40), columns) == want
    finally:
        hard_negatives.bundled.__defaults__ = held


def test_pairs_by_tiles(spark):
    left = staged(spark.range(70).select((F.col("id") % 2).alias("k"), F.col("id").alias("a")))
    right = staged(spark.range(30).select((F.col("id") % 2).alias("k"), F.col("id").alias("b")))
    want = rows_of(left.join(right, "k"), ["k", "a", "b"])
    assert rows_of(paired(left, right, ["k"]), ["k", "a", "b"]) == want
    assert rows_of(paired(left, right, ["k"], most=0, tile=7), ["k", "a", "b"]) == want
