"""The whole evaluation of an instance from stored layers: responses, vectors, judges' and entailment outputs, internals. No model is loaded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordvane.functions import fixed, overlap, scores, text, vectors
from wordvane.operators import key_points
from wordvane.sources.stores import lookup, staged


def vector_stability(rows: DataFrame) -> DataFrame:
    """instance, k, sms, trd of responses' vectors (instance, idx, v).

    sms is the mean pairwise cosine less half the mean squared distance of unit vectors from their centre, from 0 to 1; the penalty is left out below 1e-6. trd
    is the mean cosine distance from the centre of the vectors as they are. Both follow from sums: no pairs are made. A single response has 1 and 0.
    """
    v, k = F.col("v"), F.col("k").cast("double")
    units = rows.select("instance", "idx", vectors.unit(v).alias("u"), v.alias("v"))
    long = units.select("instance", F.posexplode(F.arrays_zip("u", "v")).alias("pos", "x")).groupBy("instance", "pos").agg(F.avg("x.u").alias("cu"), F.avg("x.v").alias("cv"))
    centre = long.groupBy("instance").agg(F.sum(F.col("cu") * F.col("cu")).alias("c2"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "cv"))), lambda s: s["cv"]).alias("centre"))  # one number a component
    sizes = units.groupBy("instance").agg(F.count(F.lit(1)).alias("k"), F.sum(vectors.dot(F.col("u"), F.col("u"))).alias("own"))
    drift = lookup(staged(rows), staged(centre.select("instance", "centre")), ["instance"]).groupBy("instance").agg(F.avg(1 - vectors.cosine(v, F.col("centre"))).alias("drift"))
    both = sizes.join(centre.select("instance", "c2"), "instance", "left").join(drift, "instance")
    mean = F.coalesce(F.try_divide(k * k * F.col("c2") - F.col("own"), k * (k - 1)), F.lit(0.0))
    penalty = F.coalesce(F.col("own") / k - F.col("c2"), F.lit(0.0))
    sms = F.when(k < 2, 1.0).when(penalty < 1e-6, scores.clamp01(mean)).otherwise(scores.clamp01(mean - 0.5 * penalty))
    return both.select("instance", "k", sms.alias("sms"), F.when(k < 2, 0.0).otherwise(scores.clamp01(F.col("drift"))).alias("trd"))


def hallucination(responses: DataFrame) -> DataFrame:
    """instance, hs: mean share over responses of long, uncommon words that neither input nor reference holds; 0 where these hold none."""
    ground = F.array_union(text.long_words(F.col("input_text")), text.long_words(F.col("reference")))
    facts = F.array_except(text.long_words(F.col("response")), F.array(*[F.lit(w) for w in fixed.COMMON_WORDS]))
    rows = responses.select("instance", ground.alias("ground"), facts.alias("facts"))
    share = F.try_divide(F.size(F.array_except("facts", "ground")).cast("double"), F.size("facts").cast("double"))
    return rows.groupBy("instance").agg(F.avg(F.when((F.size("ground") == 0) | (F.size("facts") == 0), 0.0).otherwise(share)).alias("hs"))


def overlaps(responses: DataFrame) -> DataFrame:
    """instance, rouge1, rouge2, rougeL (means), auc_e: 1 less the responses' coefficient of variation of ROUGE-L; a single response's score itself."""
    m = responses.select("instance", overlap.rouge(F.col("response"), F.col("reference")).alias("m")).select("instance", "m.*")
    g = m.groupBy("instance").agg(*[F.avg(c).alias(c) for c in ("rouge1", "rouge2", "rougeL")], F.stddev_samp("rougeL").alias("sd"), F.count(F.lit(1)).alias("n"))
    cv = F.coalesce(F.try_divide(F.col("sd"), F.col("rougeL")), F.lit(0.0))
    auc = F.when(F.col("n") < 2, F.col("rougeL")).when(F.col("rougeL") < 1e-9, 0.0).otherwise(scores.clamp01(1 - cv))
    return g.select("instance", "rouge1", "rouge2", "rougeL", auc.alias("auc_e"))


def evaluated(responses: DataFrame, response_vectors: DataFrame, reference_vectors: DataFrame, unit_vectors: DataFrame | Callable | None = None, judged: DataFrame | None = None, entailed: DataFrame | None = None, internals: DataFrame | None = None) -> DataFrame:
    """One row for each instance: all metrics, composites, labels and remarks.

    responses: instance, idx, input_text, reference, response; vectors: (instance, idx, v), (instance, v), (unit, v); judged and entailed: instance,
    idx, raw; internals: instance, ppl_var, bf. Without entailment outputs faithfulness is 1 - hs, without judges' outputs the human score is 0.5 (those of
    blank responses don't count), without internals their metrics are 0. Blank references give 0 for overlap and correctness.
    """
    c = F.col
    rows = staged(responses.select("instance", c("idx").cast("long").alias("idx"), *[F.coalesce(x, F.lit("")).alias(x) for x in ("input_text", "reference", "response")]))
    each = key_points.correctness(rows, response_vectors, reference_vectors)
    count = lambda f: F.count(F.when(c("flag") == f, 1)).alias(f"n_{f}")
    quality = each.groupBy("instance").agg(F.avg("cs").alias("cs"), F.avg("n_words").alias("avg_length"), F.avg("entity_coverage").alias("avg_coverage"), count("missing_reference"), count("irrelevant"))
    lengths = rows.select("instance", text.word_count(c("response")).cast("double").alias("n")).groupBy("instance").agg(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.var_pop("n"), F.avg("n") * F.avg("n")), F.lit(0.0)))).alias("trd_length"))
    covered = key_points.coverage_scores(rows, unit_vectors).select("instance", "kpig")
    out = vector_stability(response_vectors)
    for part in (covered, quality, lengths, hallucination(rows), overlaps(rows)):
        out = out.join(part, "instance")
    none = lambda name, kind="double": F.lit(None).cast(kind).alias(name)
    if entailed is not None:
        out = out.join(entailed.groupBy("instance").agg(F.avg(text.entailment_score(c("raw"))).alias("entailment")), "instance", "left")
    else:
        out = out.select("*", none("entailment"))
    if judged is not None:
        said = rows.where(c("response").rlike(r"\S")).select("instance", "idx").join(judged, ["instance", "idx"])
        out = out.join(said.groupBy("instance").agg(F.avg(text.judge_score(c("raw"))).alias("judged")), "instance", "left")
    else:
        out = out.select("*", none("judged"))
    out = out.join(internals.select("instance", "ppl_var", "bf"), "instance", "left") if internals is not None else out.select("*", none("ppl_var"), none("bf"))
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    out = out.withColumns({"ppl_var": zero("ppl_var"), "bf": zero("bf"), "hs": scores.clamp01(c("hs")), "cs": scores.clamp01(c("cs")), "human": F.coalesce("judged", F.lit(0.5))})
    out = out.withColumn("faithfulness", scores.clamp01(F.coalesce(c("entailment"), 1 - c("hs"))))
    out = out.withColumns({
        "pri": scores.pri(c("sms"), c("cs"), c("faithfulness"), c("avg_length")), "ori": scores.ori(c("sms"), c("auc_e"), c("trd"), c("kpig")), "ifi": scores.ifi(c("ppl_var"), c("bf")),
        "diagnostic_ori": scores.diagnostic_ori(c("sms"), c("auc_e"), c("trd"), c("kpig")), "diagnostic_ifi": scores.diagnostic_ifi(c("ppl_var"), c("bf")), "confidence": scores.confidence(c("sms"), c("cs"), c("faithfulness")),
        "attribution": scores.attribution([c("sms"), c("auc_e"), c("kpig")], [c("trd"), c("ppl_var"), c("bf")]),
    })
    out = out.withColumns({"diagnostic_pri": scores.diagnostic_pri(c("diagnostic_ori"), c("diagnostic_ifi")), "diagnosis": scores.diagnosis(c("diagnostic_ori"), c("diagnostic_ifi")), "usd": scores.usd(c("pri"), c("human")), "ipri": scores.ipri(c("pri"), c("cs")), "label": scores.reliability(c("pri"))})
    remarks = F.array_compact(F.array(F.when(c("avg_coverage") < 0.2, "very low coverage"), F.when(c("avg_length") < 12, "too short"), F.when(c("hs") > 0.4, "high hallucination")))
    return out.withColumns({"final": scores.final_static(c("pri"), c("human")), "final_dynamic": scores.final_dynamic(c("pri"), c("human"), c("usd")), "unstable": c("sms") < 0.1, "hallucinated": c("hs") > 0.5, "remarks": remarks}).drop("entailment", "judged")
