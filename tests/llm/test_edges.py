"""Every operator takes nulls, empty and long texts, repeats, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordvane.llm import hnsw, html_extract, language_id, mixing, packing, pii, pivot_search, shingle_join, url_filter, warc
from wordvane.llm.common import staged

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (2, None, "en", "a", 0), (3, "", None, None, 0), (4, "   \n\t ", "de", "b", 5), (5, "12 34 ?! ...", "de", "b", 5), (6, LONG, "en", None, len(LONG)),
    (7, LONG, "en", "c", len(LONG)), (8, "Der schnelle braune Fuchs springt über den faulen Hund und noch einmal", "de", "c", 60), (9, "a", "en", "c", 1),
    (10, "mail bob@example.com or +1 (269) 555-3296 from 10.0.0.1 card 4111 1111 1111 1111", "en", "a", 70), (11, "Der Hund ist im Garten und der Fuchs ist es auch", "de", "a", 50),
    (12, "\U0001f600 emoji \U0001f600 text x@y.zz", "en", "b", 9), (None, "no id at all in this row of words", "en", "b", 9),
]
CLASH = ("n", "size", "doc", "token", "tag", "spans", "score", "lang_pred", "taken", "first", "level", "_slice", "root", "piece", "length", "held_out", "key", "words")


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, DOCUMENTS)
    return frame.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


def test_mixing(docs, none):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r.doc_id: r.size for r in rows}[2] == 0
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mixing.mixed(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_shingle_join(docs, none):
    rows = shingle_join.join(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[4].component_id == 4
    assert by[7].component_id == by[6].component_id == 6 and by[9].n_shingles == 1
    assert by[None].component_id is None
    assert shingle_join.join(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack(staged(packing.pieces(docs))).collect()
    assert sum(r.piece == 0 for r in rows) == len(ROWS)
    assert {r.length for r in rows if r.doc_id == 2} == {1}
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= packing.CAPACITY
    assert packing.pack(staged(packing.pieces(none))).count() == 0


def test_pii(docs, none):
    spans = staged(pii.found(docs))
    rows = {r.doc_id: r for r in pii.with_spans(spans, pii.accepted_keys(spans)).collect()}
    assert (rows[10].n_email, rows[10].n_ip, rows[10].n_card, rows[10].n_phone) == (1, 1, 1, 1)
    assert rows[2].spans == "" and rows[12].spans == "email:15:21"
    clean = {r.doc_id: r.text for r in pii.redact(docs, []).collect()}
    assert clean[10] == "mail [EMAIL] or [PHONE] from [IP] card [CARD]" and clean[2] is None
    empty = staged(pii.found(none))
    assert pii.with_spans(empty, pii.accepted_keys(empty)).count() == 0


def test_language(docs, none):
    model = language_id.fitted(docs)
    rows = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(rows[i].lang_pred == "und" for i in (2, 3, 4, 5)) and rows[8].lang_pred in model.languages
    assert language_id.fitted(none) is None
    assert language_id.predict(none, None).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def test_pages(spark):
    page = "<html><body><nav><a href=x>menu</a></nav><article><p>One&nbsp;two <b>three</b>.</p><p>Four &amp five.</article><footer>&copy; x</footer>"
    rows = [(1, "http://A.example.com/de/x?q", page), (2, None, None), (3, "no scheme", ""), (1, "http://A.example.com/de/x?q", page), (None, "ftp://x.net/", "<p>" + "long " * 40_000), (5, "http://h.org", "<" * 5000 + "<a " * 5000 + '"')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "text", "payload", "_digest", "score")})
    got = html_extract.extract(pages).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id == 1] == ["One two three. Four & five."] * 2
    assert [r.text for r in got if r.page_id == 2] == [""] and all(r.n_chars == len(r.text) for r in got)
    judged = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert judged[1].host == "a.example.com" and judged[1].rule == "example.com/de/" and judged[1].verdict == "block"
    assert judged[2].host == "" and judged[2].verdict == "allow" and judged[3].path == "" and judged[None].rule == "net/"
    back = warc.round_trip(pages).collect()
    assert len(back) == 6 and all(r.intact for r in back) and {r.record_type for r in back if r.page_id == 1} == {"response"}
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(none).count() == url_filter.judge(none).count() == warc.round_trip(none).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (8, []), (9, [1.0, 2.0, 3.0]), (100, [-1.0, -2.0]), (1, [1.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "dim", "shard", "block", "score", "pivot")})
    near = hnsw.search(hnsw.as_vectors(e), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    mine = [r.vec_id for r in near if r.query_id == 0]
    assert mine == [1, 1, 2, 20, 100]
    exact = pivot_search.search(hnsw.as_vectors(e, zero=True), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.vec_id, r.score) for r in exact if r.query_id == 0] == [(1, 1024**2), (1, 1024**2), (2, 1024**2), (20, 1024 * 512), (7, 0), (100, -(1024**2))]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.search(hnsw.as_vectors(none), F.lit(True)).count() == 0
    assert pivot_search.search(hnsw.as_vectors(none, zero=True), F.lit(True)).count() == 0


def test_pipeline_stages(spark, docs, none):
    for start in (docs, none):
        frame = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, frame = frame, staged(stage(spark, frame, ""))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert frame.columns == before.columns
        assert (frame.count() > 0) == (start is docs)
