"""Providers of what models give: stored outputs by join, or a deterministic simulator. The engine never loads a model."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordvane.functions.text import hashed_uniform


class Provider(Protocol):
    def score(self, requests: DataFrame) -> DataFrame: ...


class TableProvider:
    """Stored outputs, joined by key; an empty stored text is a miss, as if it weren't there."""

    def __init__(self, stored: DataFrame, keys: list[str], output: str = "response"):
        self.stored, self.keys, self.output = stored, keys, output

    def score(self, requests: DataFrame) -> DataFrame:
        held = self.stored.where(F.coalesce(F.col(self.output), F.lit("")) != "").select(*self.keys, self.output)
        return requests.join(held, self.keys, "left")

    def misses(self, requests: DataFrame) -> DataFrame:
        return self.score(requests).where(F.col(self.output).isNull()).drop(self.output)


class SimulatorProvider:
    """Responses mixed from reference and input words by hash: the share of the reference is the model's coherence."""

    def __init__(self, coherence: float = 0.7, words: int = 40):
        self.coherence, self.words = coherence, words

    def score(self, requests: DataFrame) -> DataFrame:
        """requests: model, instance_id, variant_idx, input_text, reference_output."""
        from wordvane.functions.text import words

        key = F.concat_ws("|", "model", "instance_id", F.col("variant_idx").cast("string"))
        frame = requests.withColumn("_r", words(F.col("reference_output"))).withColumn("_i", words(F.col("input_text"))).withColumn("_k", key)
        source = lambda i: F.when(hashed_uniform(F.concat(F.col("_k"), F.lit("#"), i.cast("string"))) < self.coherence, F.get("_r", i % F.greatest(F.size("_r"), F.lit(1)))).otherwise(F.get("_i", i % F.greatest(F.size("_i"), F.lit(1))))
        text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(self.words - 1)), source), " ")
        return frame.withColumn("response", text).withColumn("ppl", 5 + 45 * hashed_uniform(F.concat(F.col("_k"), F.lit("ppl")))).withColumn("bf", 1 + 3 * hashed_uniform(F.concat(F.col("_k"), F.lit("bf")))).drop("_r", "_i", "_k")


def run_provider(provider: Provider, requests: DataFrame, fallback: Provider | None = None) -> DataFrame:
    """Outputs of a provider; what a table lacks comes from the fallback."""
    out = provider.score(requests)
    if fallback is None or not isinstance(provider, TableProvider):
        return out
    made = fallback.score(provider.misses(requests)).select(*out.columns)
    return out.where(F.col(provider.output).isNotNull()).unionByName(made)
