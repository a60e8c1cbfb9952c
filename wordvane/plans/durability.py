"""Runs that survive bad rows, replays and restarts: isolated failures, the cache, incremental appends. Each query writes to a new folder of the shared one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordvane.functions import text
from wordvane.operators.isolation import Stage, open_letters, to_do, write_isolated
from wordvane.plans.catalog import query
from wordvane.plans.dialogue import WORDS
from wordvane.session import table
from wordvane.sources import cache
from wordvane.sources.stores import shared_dir
from wordvane.streaming import incremental


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stages() -> list[Stage]:
    return [
        Stage("parse", {"words_raw": F.get_json_object("payload", "$.words")}, required=("words_raw",)),
        Stage("convert", {"words": F.expr("try_cast(words_raw as int)")}, required=("words",)),
        Stage("measure", {"ratio": F.try_divide(F.length("text").cast("double"), F.col("words").cast("double"))}, errors=[("NoText", F.coalesce("text", F.lit("")).rlike(r"^\s*$")), ("NoWords", F.col("words") == 0)]),
    ]


@query(f"""with n as (select doc_id, doc_id % 17 = 3 as cut, doc_id % 19 = 5 as wrong, regexp_matches(coalesce(text, ''), '^\\s*$') as blank, length(text)::double / nullif(len({WORDS.format('text')}), 0) as ratio from documents)
select doc_id, case when cut then 2 when wrong or blank then 2 else 1 end as attempt, case when not wrong and not blank then round(ratio, 6) end as ratio, case when wrong then 'convert' when blank then 'measure' end as stage, case when wrong then 'missing:words' when blank then 'NoText' end as error from n""")
def failure_isolation(spark, sf_dir):
    """Three stages over rows of which some are poisoned. The second attempt takes up what the first didn't finish, of which the
    malformed ones have been mended; each row ends among the good ones or as an open letter."""
    good, dead = folder(spark, "good"), folder(spark, "dead")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", text.word_count(F.col("text")).alias("n"))
    whole = F.concat(F.lit('{"words": '), F.when(F.col("doc_id") % 19 == 5, F.lit('"many"')).otherwise(F.col("n").cast("string")), F.lit("}"))
    first = d.withColumn("payload", F.when(F.col("doc_id") % 17 == 3, F.lit('{"words": ')).otherwise(whole)).drop("n")
    write_isolated(first, stages(), ["doc_id"], good, dead, 1)
    write_isolated(to_do(d.withColumn("payload", whole).drop("n"), ["doc_id"], good), stages(), ["doc_id"], good, dead, 2)
    fine = spark.read.parquet(good).select("doc_id", "attempt", F.round("ratio", 6).alias("ratio"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("error"))
    letters = open_letters(spark, ["doc_id"], good, dead)
    return fine.unionByName(letters.select("doc_id", "attempt", F.lit(None).cast("double").alias("ratio"), "stage", "error"))


@query("""select conv_id, turn, 'resp_' || md5('{"first": ' || case when turn = 0 then 'true' else 'false' end || ', "prompt": ' || array_to_string(list_transform(string_split(to_json(text)::varchar, ''), lambda c: case when unicode(c) > 126 then printf('\\u%04x', unicode(c)) else c end), '') || ', "turn": ' || turn || '}') as key from conversations where text is not null""")
def cache_keys(spark, sf_dir):
    """md5 of the JSON of sorted keys, as json.dumps() writes it."""
    t = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.col("text").alias("prompt"), (F.col("turn") == 0).alias("first"))
    return t.select("conv_id", "turn", cache.cache_key(t, "resp", ["prompt", "turn", "first"]).alias("key"))


def keyed_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.col("user_id").alias("user"), "event_id", "props", (F.col("event_id") % 4).alias("version"))
    return e.withColumn("key", cache.cache_key(e, "resp", ["event", "user"]))


KEY = """'resp_' || md5('{"event": "' || event_type || '", "user": ' || user_id || '}')"""


@query(f"select {KEY} as key, arg_max(props, (event_id % 4, event_id)) as value from events group by 1")
def cache_last_values(spark, sf_dir):
    """Four appends, a compaction after the second, an append written twice; of each key the value of its newest version."""
    path, e = folder(spark, "cache"), keyed_events(spark, sf_dir).withColumnRenamed("props", "value")
    for k in range(4):
        cache.put(e.where(F.col("version") == k), path, order="event_id")
        if k == 1:
            cache.compact(spark, path)
    cache.put(e.where("version = 3"), path, order="event_id", version=3)
    return cache.last_values(spark, path)


@query(f"""with k as (select distinct event_type, user_id, {KEY} as key from events), c as (select {KEY} as key, arg_max(case when user_id % 10 = 4 then '' else props end, event_id) as v from events where user_id % 2 = 0 group by 1)
select k.key, coalesce(nullif(v, ''), 'filled ' || event_type || ' ' || user_id) as value, coalesce(nullif(v, ''), 'filled ' || event_type || ' ' || user_id) as again from k left join c using (key)""")
def cache_get_or_fill(spark, sf_dir):
    """Hits and misses by one join; misses (and blank values) are filled once and found by the next reader."""
    path, e = folder(spark, "cache"), keyed_events(spark, sf_dir)
    cache.put(e.where("user % 2 = 0").select("key", "event_id", F.when(F.col("user") % 10 == 4, "").otherwise(F.col("props")).alias("value")), path, order="event_id")
    asked = e.select("key", "event", "user").distinct()
    got = cache.get_or_fill(asked, path, lambda rows: rows.select("key", F.concat_ws(" ", F.lit("filled"), "event", F.col("user").cast("string")).alias("value")))
    return got.select("key", "value").join(cache.last_values(spark, path).withColumnRenamed("value", "again"), "key")


@query("""select event_type, user_id, count(*) as n, round(sum(value * 2), 4) as total, count(*) as n_replayed from events where event_id % 2 = 0 or event_id % 3 <> 0 group by all""")
def incremental_append(spark, sf_dir):
    """A stream of events that arrive in two overlapping parts, CSV batches and a ledger; a third run finds nothing new, a replayed batch leaves the sink as it is."""
    schema = "event_id long, user_id long, event_type string, value double"
    source, sink, check = folder(spark, "events"), folder(spark, "sink"), folder(spark, "check")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    for arrived in (e.where("event_id % 2 = 0"), e.where("event_id % 3 <> 0"), None):  # the second overlaps the first, the third is nothing
        if arrived is not None:
            arrived.write.mode("append").parquet(source)
        incremental.process_new(spark, source, schema, lambda d: d.withColumn("value", F.col("value") * 2), sink, check, keys=["event_id"], format="csv")
    once = incremental.read_sink(spark, sink, schema, "csv")
    batch = incremental.completed(spark, sink).first()
    incremental.append_batch(once.select("event_id", "user_id", "event_type", "value"), sink, batch["query"], batch["batch"], "csv")
    again = incremental.read_sink(spark, sink, schema, "csv").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n_replayed"))
    total = once.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return total.join(again, ["event_type", "user_id"]).select("event_type", "user_id", "n", "total", "n_replayed")
