"""The arbiter of borderline pairs: a plug-in for a language model, and a rule that stands in for it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded

VERDICT = "s1_id string, cand_id string, line long, is_match boolean, confidence double, rationale string"


def judge(pairs: DataFrame, arbiter: Callable[[Iterator], Iterator]) -> DataFrame:
    """Verdicts of any batch function of (s1_id, cand_id, prompt)."""
    return pairs.mapInPandas(arbiter, VERDICT)


def by_rule(featured: DataFrame) -> DataFrame:
    """Deterministic verdicts from features."""
    strength = rounded(0.5 * F.col("name_jaccard") + 0.5 * F.col("address_token_jaccard"), 6)
    return featured.select("s1_id", "cand_id", F.col("rank").cast("long").alias("line"), (strength >= 0.6).alias("is_match"), rounded(F.greatest(strength, 1 - strength), 6).alias("confidence"), F.lit("rule").alias("rationale"))
