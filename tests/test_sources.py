"""Readers, writers, contracts, resuming and streaming."""

import json

from pyspark.sql import functions as F

from wordvane.operators import acceptance, coverage, perturb
from wordvane.operators.providers import SimulatorProvider, TableProvider, run_provider
from wordvane.sources import layers, sinks
from wordvane.streaming import incremental


def record(i, variants, **metadata):
    return {"instance_id": f"summ_{i:04d}", "task": "qa", "base_text": "base", "metadata": metadata, "variants": [{"variant_idx": k, "paraphrased_text": t, "sbert_similarity": 0.9, "strategy": "synonyms", "full_prompt": p} for k, (t, p) in enumerate(variants)]}


def test_nested_round_trip(spark, tmp_path):
    rows = [record(0, [("a, \"b\"\nc", "p0"), ("x", "")], input_text="in", reference_output="ref"), record(1, []), record(2, [("y", "p2")], article="old", gold_summary="gold")]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n" + '{"instance_id": "cut')
    nested = layers.read_jsonl(spark, str(tmp_path / "in.jsonl"))
    assert nested.count() == 3
    got = {r.instance_id: r for r in layers.read_dataset(spark, str(tmp_path / "in.jsonl")).collect()}
    assert set(got) == {"summ_0000", "summ_0002"} and got["summ_0000"].prompt_variants == ["p0"]
    assert (got["summ_0002"].input_text, got["summ_0002"].reference_output) == ("old", "gold")
    sinks.write_both(nested, str(tmp_path / "o.jsonl"), str(tmp_path / "o.csv"), layers.VARIANTS)
    back = layers.read_csv(spark, str(tmp_path / "o.csv"), layers.VARIANTS)
    assert back.count() == 3 and {r.paraphrased_text for r in back.collect()} == {"a, \"b\"\nc", "x", "y"}
    text = layers.read_csv(spark, str(tmp_path / "o.csv"), layers.VARIANTS, typed=False)
    assert {r.full_prompt for r in text.collect()} == {"p0", "", "p2"}
    assert layers.newest(spark, str(tmp_path)).endswith("in.jsonl")


def test_contract(spark):
    rows = [("m", "i", "t", k, "s", "p", "r", "in", "ref", None, None) for k in (0, 2)]
    ok, issues = layers.check_contract(spark.createDataFrame(rows, layers.RESPONSES), layers.RESPONSES)
    assert not ok and "gaps" in issues[0]
    ok, issues = layers.check_contract(spark.createDataFrame(rows[:1], layers.RESPONSES), layers.RESPONSES)
    assert ok and not issues
    bad = spark.createDataFrame(rows[:1], layers.RESPONSES).drop("prompt").withColumn("more", F.lit(1)).withColumn("response", F.lit(None).cast("string"))
    assert len(layers.check_contract(bad, layers.RESPONSES)[1]) == 3
    assert layers.check_contract(spark.createDataFrame([], layers.RESPONSES), layers.RESPONSES)[1] == ["no rows"]
    grouped = layers.grouped_responses(spark.createDataFrame(rows[::-1], layers.RESPONSES)).first()
    assert grouped.precomputed_responses == ["r", "r"]


def test_append_and_resume(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append_rows(spark.createDataFrame([("a", 1)], "k string, v int"), path, "k string, v int")
    sinks.append_rows(spark.createDataFrame([("b", 2, 3.0)], "k string, v int, w double"), path, "k string, v int, w double")
    got = {r.k: r.w for r in sinks.merge_schema(spark, path, "k string, v int, w double").collect()}
    assert got == {"a": None, "b": 3.0}
    todo = sinks.pending(spark.createDataFrame([("a",), ("c",)], "k string"), spark.read.parquet(path), ["k"])
    assert [r.k for r in todo.collect()] == ["c"]
    assert json.loads(sinks.report(spark.createDataFrame([(1, "x")], "n int, s string"))) == {"n": 1, "s": "x"}
    sinks.write_partitioned(spark.createDataFrame([("a", 1), (None, 2)], "k string, v int"), str(tmp_path / "p"), "k")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_streaming_takes_each_file_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    double = lambda d: d.withColumn("v", F.col("v") * 2)
    for k in range(2):
        spark.createDataFrame([("a", 1), (f"b{k}", 2)], "k string, v int").coalesce(1).write.mode("append").parquet(src)
        incremental.process_new(spark, src, "k string, v int", double, out, check, keys=["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [("a", 2), ("b0", 4), ("b1", 4)]
    seen = []
    incremental.upsert_new(spark, src, "k string, v int", ["k"], lambda d, n: seen.extend(r.k for r in d.collect()), str(tmp_path / "check2"))
    assert sorted(seen) == ["a", "b0", "b1"]


def test_providers(spark):
    ask = spark.createDataFrame([("m", f"i{k}", 0, "in put words", "the reference text") for k in range(3)], "model string, instance_id string, variant_idx int, input_text string, reference_output string")
    stored = spark.createDataFrame([("i0", "held"), ("i1", "")], "instance_id string, response string")
    got = {r.instance_id: r.response for r in run_provider(TableProvider(stored, ["instance_id"]), ask, SimulatorProvider(words=5)).collect()}
    assert got["i0"] == "held" and len(got["i1"].split()) == 5 and len(got) == 3
    one, two = (SimulatorProvider().score(ask).orderBy("instance_id").collect() for _ in range(2))
    assert one == two


def test_greedy_acceptance(spark):
    long = "one two three four five"
    rows = [(1, 0, "s", "base text is here now", long), (1, 1, "s", "base text is here now", long + " six"), (1, 2, "t", "base text is here now", long), (1, 3, "t", "base text is here now", "short"), (1, 4, "t", "base text is here now", "alpha beta gamma delta epsilon"), (1, 5, "t", "base text is here now", "BASE text is here now ")]
    got = acceptance.greedy_accept(spark.createDataFrame(rows, "instance long, attempt long, strategy string, base string, text string")).orderBy("variant_idx").collect()
    assert [(r.attempt, r.variant_idx) for r in got] == [(0, 0), (1, 1), (4, 2)]


def test_coverage_and_perturbed(spark):
    rows = [(1, 0, "Daniel Radcliffe sang songs", "Daniel Radcliffe sang songs"), (1, 1, "Daniel Radcliffe sang songs", "nothing here matches")]
    r = coverage.key_point_coverage(spark.createDataFrame(rows, "instance long, idx long, reference string, response string")).first()
    assert r.coverage == 0.5 and 0 < r.kpig <= 1
    v = perturb.variants(spark.createDataFrame([(1, "This is fine. I do not know, it is late")], "id int, t string"), "t").collect()
    assert {x.strategy for x in v} <= {f"adv:{s}" for s in perturb.STRATEGIES} and len(v) == 5
