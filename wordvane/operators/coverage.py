"""Key-point coverage of responses: units, TF-IDF importance, redundancy, matches by stored vectors or by equality of units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordvane.functions import text


def key_point_coverage(responses: DataFrame) -> DataFrame:
    """instance, kpig, coverage. responses: instance, idx, reference, response; a unit is matched where a response holds it.

    Importance of a unit is its mean normalised TF-IDF over reference and responses (idf ln((1 + n) / (1 + df)) + 1, rows of unit
    length), at least 0.1, over the greatest; units of several words have no weight of their own and get the floor. Redundancy is
    1 / (1 + responses that hold it); weights mix both. The stable part of coverage over responses damps the sum.
    """
    texts = responses.select("instance", F.col("idx"), F.col("response").alias("t")).unionByName(responses.groupBy("instance").agg(F.first("reference").alias("t")).select("instance", F.lit(-1).cast("long").alias("idx"), "t"))
    n = texts.groupBy("instance").agg(F.count(F.lit(1)).alias("n"))
    tf = texts.select("instance", "idx", F.explode(text.content_tokens(F.col("t"))).alias("u")).groupBy("instance", "idx", "u").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("instance", "u").agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(df, ["instance", "u"]).join(n, "instance").withColumn("x", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = w.groupBy("instance", "idx").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    weight = w.join(length, ["instance", "idx"]).groupBy("instance", "u").agg((F.sum(F.col("x") / F.col("len")) / F.first("n")).alias("imp"))
    units = texts.where("idx = -1").select("instance", F.explode(text.key_units(F.col("t"))).alias("u"))
    held = texts.where("idx >= 0").select("instance", "idx", F.explode(text.key_units(F.col("t"))).alias("u"))
    freq = held.groupBy("instance", "u").agg(F.count_distinct("idx").alias("freq"))
    u = units.join(weight, ["instance", "u"], "left").join(freq, ["instance", "u"], "left").withColumn("imp", F.greatest(F.coalesce("imp", F.lit(0.0)), F.lit(0.1)))
    most = u.groupBy("instance").agg(F.max("imp").alias("most"), F.count(F.lit(1)).alias("n_units"))
    u = u.join(most, "instance").withColumn("w", F.col("imp") / F.col("most") * (0.3 + 0.7 / (1 + F.coalesce("freq", F.lit(0)))))
    base = u.groupBy("instance").agg((F.sum(F.when(F.col("freq") > 0, F.col("w")).otherwise(0.0)) / (F.sum("w") + 1e-8)).alias("base"), F.first("n_units").alias("n_units"))
    hits = held.join(units, ["instance", "u"]).groupBy("instance", "idx").agg(F.count_distinct("u").alias("hits"))
    each = texts.where("idx >= 0").select("instance", "idx").join(hits, ["instance", "idx"], "left").join(base, "instance").withColumn("c", F.coalesce("hits", F.lit(0)) / F.col("n_units"))
    out = each.groupBy("instance").agg(F.first("base").alias("base"), F.avg("c").alias("coverage"), F.stddev_pop("c").alias("sd"), F.count(F.lit(1)).alias("k"))
    stable = F.when(F.col("k") < 2, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - F.exp(-3 * F.col("sd"))))
    return out.select("instance", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("base") * stable)), 6).alias("kpig"), F.round("coverage", 6).alias("coverage"))
