"""Missing and present inputs, files in order, counted writes, per-model output, validation of hand-made records."""

import json

import pytest
from pyspark.sql import functions as F

from wordvane.operators import validation
from wordvane.sources import layers, results


def test_required_and_optional(spark, tmp_path):
    path = str(tmp_path / "baseline.json")
    with pytest.raises(results.MissingResults, match="run the baseline first"):
        results.required(spark, path, "run the baseline first")
    empty = results.optional(spark, path, "article_idx long, rouge_mean double")
    assert empty.count() == 0 and empty.columns == ["article_idx", "rouge_mean"]
    (tmp_path / "baseline.json").write_text(json.dumps({"config": {"k": 1}, "results": [{"article_idx": 3, "rouge_mean": 0.5, "rouge_var": 0.1}, {"article_idx": 4, "other_rouge_l": 0.2}]}))
    read = lambda s, p: results.run_results(s, p, prefix="other_")
    for found in (results.required(spark, path, "", read), results.optional(spark, path, "article_idx long", read)):
        assert [(r.article_idx, r.rouge_mean, r.treated_rouge_l) for r in found.orderBy("article_idx").collect()] == [(3, 0.5, None), (4, None, 0.2)]
    assert results.read_lines(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "broken.json").mkdir()
    with pytest.raises(Exception) as e:
        results.required(spark, str(tmp_path / "broken.json"), "", lambda s, p: s.read.parquet(p))
    assert not isinstance(e.value, results.MissingResults)  # there, but not readable: another error


def test_files_in_order(spark, tmp_path):
    for name, start in (("train-b", 100), ("train-a", 0), ("train-c", 200), ("other", 900)):
        spark.range(start, start + 10).select(F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, "x").otherwise(" ").alias("t")).coalesce(1).write.parquet(str(tmp_path / name))
    glob, keep = str(tmp_path / "train-*"), F.trim("t") != ""
    take = lambda n: [r.n for r in results.first_rows_of_files(spark, glob, keep, n).collect()]
    assert take(3) == [0, 2, 4] and take(7) == [0, 2, 4, 6, 8, 100, 102] and len(take(99)) == 15


def record(task, k, variants, **metadata):
    return {"instance_id": f"{task}_{k}", "task": task, "base_text": "the base text of five words", "metadata": metadata, "variants": [{"variant_idx": i, "paraphrased_text": t, "sbert_similarity": s, "strategy": "s", "full_prompt": p} for i, (t, s, p) in enumerate(variants)]}


def test_counted_writes(spark, tmp_path):
    rows = [record("qa", k, [("a", 0.9, "p")] * k) for k in range(4)]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert results.csv_of_lines(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out.csv"), layers.VARIANTS) == 6 == layers.read_csv(spark, str(tmp_path / "out.csv"), layers.VARIANTS).count()
    nested = layers.read_jsonl(spark, str(tmp_path / "in.jsonl"))
    assert results.write_nested_and_flat(nested, str(tmp_path / "o.jsonl"), str(tmp_path / "o.csv"), layers.VARIANTS) == (4, 6)
    assert layers.read_jsonl(spark, str(tmp_path / "o.jsonl")).count() == 4 and layers.read_csv(spark, str(tmp_path / "o.csv"), layers.VARIANTS).count() == 6


def test_models(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    frame = spark.createDataFrame([("org/a", " x"), ("org/a", "y "), ("b", 'q"')], "model string, v string").mapInArrow(seen, "model string, v string")
    assert results.write_models(frame, str(tmp_path / "m"), str(tmp_path / "all")) == {"org/a": 2, "b": 1}
    assert calls.value == 3  # evaluated once
    assert results.write_models(spark.createDataFrame([("b", "new")], "model string, v string"), str(tmp_path / "m"), str(tmp_path / "all")) == {"b": 1}
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(str(tmp_path / "m"))
    assert sorted((r.file, r.v) for r in back.collect()) == [("b", "new"), ("org_a", " x"), ("org_a", "y ")]
    assert spark.read.parquet(str(tmp_path / "all")).count() == 4


def test_validation(spark, tmp_path):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        record("qa", 0, [(long, 0.9, f"Do: {long}"), ("the base text of five words", 0.5, "Do: the base text of five words")], reference_output="gold"),
        record("qa", 1, [("short", None, "Do: the base text of five words short"), ("w " * 20, 0.95, "none of it")], gold_summary=" "),
        record("creative", 2, [], reference_output="gold"),
    ]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)))
    nested = layers.read_jsonl(spark, str(tmp_path / "in.jsonl"))
    found = validation.findings(nested, 2, 2)
    got = sorted((r.task, r.instance_id or "", -1 if r.variant_idx is None else r.variant_idx, r.check_id, r.severity) for r in found.collect())
    w = "warning"
    assert got == [
        ("creative", "", -1, "Q01", "error"), ("creative", "creative_2", -1, "Q01", w), ("qa", "qa_0", 1, "Q02", w), ("qa", "qa_0", 1, "Q05", w), ("qa", "qa_1", -1, "Q07", w),
        ("qa", "qa_1", 0, "Q02", w), ("qa", "qa_1", 0, "Q04", w), ("qa", "qa_1", 0, "Q06", w), ("qa", "qa_1", 1, "Q04", w), ("qa", "qa_1", 1, "Q06", w),
    ]
    assert [r.instance_id for r in validation.diversity_findings(nested, 15).collect()] == ["qa_0"]
    tasks = spark.createDataFrame([("qa",), ("creative",), ("gone",)], "task string")
    s = {r.task: r for r in validation.summary(nested, found, tasks).collect()}
    assert (s["qa"].passed, s["qa"].warnings, s["qa"].instances, s["qa"].variants, s["qa"].messages[0]) == (True, 8, 2, 4, "Q02 qa_0 1") and s["qa"].mean_similarity == pytest.approx((0.9 + 0.5 + 0.95) / 4)
    assert (s["creative"].passed, s["creative"].errors, s["creative"].mean_similarity) == (False, 1, None) and (s["gone"].status, s["gone"].errors, s["gone"].passed) == ("missing_file", 1, False)
    t = spark.createDataFrame([("summarization", "Summarize: {}"), ("summarization", "Condense: {}"), ("qa", "Answer: {}")], "task string, template string")
    assert [r.template for r in validation.template_warnings(t).collect()] == ["Condense: {}"]
