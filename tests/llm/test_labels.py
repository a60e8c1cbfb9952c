"""More languages than a sample has room for."""

from pyspark.sql import functions as F

from wordvane.llm import language_id


def test_every_language_is_learned(spark):
    rows = [(i, f"some words of text number {i}", f"l{i % 230:03d}" if i < 1380 else "common") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = {r.lang for r in docs.where(~language_id.held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    assert len(labels) > 200
    assert {lang for lang, _ in language_id.training_sample(docs)} == labels
    assert {lang for lang, _ in language_id.training_sample(docs, size=100)} == labels
