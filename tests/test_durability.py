"""Bad rows, broken sources, replays, half-written batches, cache keys and compactions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from wordvane.operators import isolation
from wordvane.operators.isolation import PythonStage, Stage
from wordvane.sources import cache
from wordvane.streaming import incremental


def stages(f):
    return [Stage("check", {"n": F.expr("try_cast(v as int)")}, errors=[("Empty", F.col("v") == "")], required=("n",)), PythonStage("invert", "inverse", "n", f, "double"), Stage("double", {"twice": F.col("inverse") * 2})]


def inverse():
    def f(n):
        if n == 13:
            raise KeyError("unlucky")
        return 1.0 / n

    return f  # not by name: the workers don't know this module


def test_no_good_row_is_lost(spark, tmp_path):
    good, dead = str(tmp_path / "good"), str(tmp_path / "dead")
    bad = {3: "", 5: "x", 7: "0", 13: "13", 20: None}
    source = spark.createDataFrame([(k, bad.get(k, str(k + 1))) for k in range(40) if k != 12], "k long, v string")
    assert isolation.write_isolated(isolation.to_do(source, ["k"], good), stages(inverse()), ["k"], good, dead, 1) == (34, 5)
    letters = {r.k: (r.stage, r.error) for r in isolation.open_letters(spark, ["k"], good, dead).collect()}
    assert letters == {3: ("check", "Empty"), 5: ("check", "missing:n"), 7: ("invert", "ZeroDivisionError"), 13: ("invert", "KeyError"), 20: ("check", "missing:n")}
    assert all(r.twice == pytest.approx(2 / (r.k + 1)) for r in spark.read.parquet(good).collect())
    # A resume takes the dead letters alone; the mended ones move over.
    again = isolation.to_do(source, ["k"], good)
    assert sorted(r.k for r in again.collect()) == sorted(bad)
    fixed = again.withColumn("v", F.when(F.col("k") == 5, "6").otherwise(F.col("v")))
    for _ in range(2):  # a repeated attempt changes nothing
        assert isolation.write_isolated(fixed, stages(lambda n: 1.0 / (n or 4)), ["k"], good, dead, 2) == (3, 2)
        assert {r.k for r in isolation.open_letters(spark, ["k"], good, dead).collect()} == {3, 20}
        assert spark.read.parquet(good).count() == 37


def test_broken_source_stops_no_other(spark):
    readers = {"fine": lambda s: s.range(3), "gone": lambda s: s.read.parquet("/nowhere/at/all"), "odd": lambda s: s.range(1).select(F.lit(1).alias("x"))}
    rows, failed = isolation.read_all(spark, readers, ["id"])
    assert rows.count() == 3 and set(failed) == {"gone", "odd"} and isolation.read_all(spark, {"gone": readers["gone"]}, ["id"])[0] is None


def test_keys_are_those_of_json(spark):
    texts = ['plain "quoted" \\ back', "tab\tline\nreturn\r\b\f", "\x01\x1f\x7f", "café 中 \U0001f600\U0001f468", "", None]
    frame = spark.createDataFrame([(t, k, k % 2 == 0) for k, t in enumerate(texts)], "prompt string, n int, Flag boolean")
    got = {r.n: r.key for r in frame.select("n", cache.cache_key(frame, "resp", ["prompt", "n", "Flag"]).alias("key")).collect()}
    for k, t in enumerate(texts):
        want = json.dumps({"prompt": t, "n": k, "Flag": k % 2 == 0}, sort_keys=True)
        assert got[k] == "resp_" + hashlib.md5(want.encode()).hexdigest(), t
    with pytest.raises(TypeError):
        cache.cache_key(frame.withColumn("d", F.lit(1.5)), "p", ["d"])


def test_cache(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = lambda *r: spark.createDataFrame(list(r), "key string, value string")
    held = lambda: {r.key: r.value for r in cache.last_values(spark, path).collect()}
    assert held() == {}
    assert [cache.put(rows(("a", "1"), ("b", "1")), path), cache.put(rows(("a", "2"), ("c", "2")), path)] == [0, 1]
    assert held() == {"a": "2", "b": "1", "c": "2"}
    rows(("a", "half"), ("z", "half")).write.parquet(f"{path}/log/version=2")  # died before it was complete
    assert held() == {"a": "2", "b": "1", "c": "2"}
    before = held()
    assert cache.compact(spark, path, buckets=4) == 1 and held() == before
    assert cache.put(rows(("b", "3")), path) == 2 and held() == before | {"b": "3"}
    cache.put(rows(("b", "3"), ("d", "3")), path, version=2)
    assert cache.compact(spark, path, buckets=4) == 2 and held() == before | {"b": "3", "d": "3"}
    calls = []

    def fill(missing):
        calls.append(sorted(r.key for r in missing.collect()))
        return missing.select("key", F.concat(F.lit("new "), "key").alias("value"))

    asked = spark.createDataFrame([("a", 1), ("x", 2), ("x", 3)], "key string, n int")
    for _ in range(2):
        assert sorted((r.n, r.value) for r in cache.get_or_fill(asked, path, fill).collect()) == [(1, "2"), (2, "new x"), (3, "new x")]
    assert calls == [["x"], []]


def test_large_caches_keep_types(spark, tmp_path):
    path = str(tmp_path / "n")
    cache.put(spark.createDataFrame([("a", 1.5, 1), ("a", 2.5, 2)], "key string, value double, o int"), path, order="o")
    cache.compact(spark, path, "double")
    assert [r.value for r in cache.last_values(spark, path, "double").collect()] == [2.5]


@pytest.mark.parametrize("format", ["parquet", "csv", "json"])
def test_replays_leave_the_sink_as_it_is(spark, tmp_path, format):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    schema, same = "k string, v int", lambda d: d
    for k in range(3):
        spark.createDataFrame([("a", 1), (f'b"{k},\n', 2)], schema).coalesce(1).write.mode("append").parquet(src)
        incremental.process_new(spark, src, schema, same, out, check, keys=["k"], format=format)
    want = [("a", 1)] + [(f'b"{k},\n', 2) for k in range(3)]
    held = lambda: sorted((r.k, r.v) for r in incremental.read_sink(spark, out, schema, format).collect())
    assert held() == want
    batch = incremental.completed(spark, out).orderBy("batch").first()
    assert incremental.append_batch(spark.createDataFrame([("other", 9)], schema), out, batch["query"], batch["batch"], format) == batch["rows"] and held() == want
    # A batch that died before its entry in the ledger isn't read, and is replaced when it comes again.
    spark.createDataFrame([("half", 1)], schema).write.format(format).options(**incremental.FORMATS[format]).save(f"{out}/query={batch['query']}/batch=99")
    assert held() == want
    incremental.append_batch(spark.createDataFrame([("whole", 1)], schema), out, batch["query"], 99, format)
    assert held() == sorted([*want, ("whole", 1)])
    # A new checkpoint takes everything again, and finds that its keys have been met.
    incremental.process_new(spark, src, schema, same, out, str(tmp_path / "check2"), keys=["k"], format=format)
    assert held() == sorted([*want, ("whole", 1)])


def test_upserts(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    for v in (1, 2):
        spark.createDataFrame([("a", v), (f"b{v}", v)], "k string, v int").coalesce(1).write.mode("append").parquet(src)
        incremental.upsert_new(spark, src, "k string, v int", ["k"], lambda d, n: incremental.upsert(d, out, ["k"], n), check)
    assert sorted((r.k, r.v) for r in incremental.upserted(spark, out, ["k"]).collect()) == [("a", 2), ("b1", 1), ("b2", 2)]
