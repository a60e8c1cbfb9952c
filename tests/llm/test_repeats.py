"""Repeated query rows, and rows of a query's own id."""

from pyspark.sql import functions as F

from wordvane.llm import hnsw

VECTORS = "vec_id long, embedding array<double>"


def near(spark, rows):
    found = hnsw.search(hnsw.as_vectors(spark.createDataFrame(rows, VECTORS)), F.col("vec_id") == 100).orderBy("query_id", "rank", "vec_id").collect()
    return [(r["rank"], r.vec_id) for r in found]


def test_hnsw_repeated_queries(spark):
    rows = [(i, [1.0, i / 50]) for i in range(30)]
    once = near(spark, [*rows, (100, [1.0, 0.0])])
    assert once == [(k + 1, k) for k in range(20)]
    assert near(spark, [*rows, *[(100, [1.0, 0.0])] * 3]) == once
    both = near(spark, [*rows, (100, [1.0, 0.0]), (100, [-1.0, 1.0])])
    assert len(both) == 40 and set(once) <= set(both) and {v for _, v in both} == set(range(30))


def test_hnsw_own_rows_leave_room(spark):
    rows = [(i, [1.0, 0.0]) for i in range(101, 141)]
    assert near(spark, [*[(100, [1.0, 0.0])] * 45, *rows]) == [(k + 1, 101 + k) for k in range(20)]
