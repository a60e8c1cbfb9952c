"""The registered queries: names, contracts' columns, and results against SQL."""

import duckdb
import pytest

from wordvane.llm import registry

COLUMNS = {
    "op1": "page_id url text n_chars", "op2": "doc_id size source_size target taken", "op3": "query_id rank vec_id score", "op4": "doc_id n_shingles component_id", "op5": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op7": "query_id rank vec_id score", "op8": "page_id payload_bytes payload_digest record_type refers_to", "op9": "doc_id held_out lang_pred score", "op10": "page_id host path rule verdict",
    "op11": "vec_id code error label_error codebooks_sha256", "op12": "doc_id keep_id group_size kept text_sha256", "op13": "anchor_id positive_id rank negative_id positive_score negative_score",
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_columns(spark, sf, name):
    if name == "pipeline":
        return
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(registry.queries()[name](spark, sf).columns)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(str([tidy(v) for v in row]) for row in found.fetchall())
    frame = registry.queries()[name](spark, sf)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(str([tidy(v) for v in row]) for row in frame.select(*names).collect()) == want
