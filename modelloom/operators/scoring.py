"""Scores: the share of a category's objects that findings affect, never a pass for what could not be checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tenths of an object that a finding of each severity affects.
TENTHS = {"critical": 10, "high": 6, "medium": 3, "low": 1}


def category_scores(findings: DataFrame, populations: DataFrame) -> DataFrame:
    """score of each (category, population): 100 less the affected percentage, rounded half up into 0..100; null for no population.

    An object counts with its worst finding: a maximum per object, then a sum, both combined before the shuffle."""
    tenths = F.create_map(*(F.lit(x) for kv in TENTHS.items() for x in kv))
    worst = findings.groupBy("category", "target").agg(F.max(tenths[F.col("severity")]).alias("tenths"))
    affected = worst.groupBy("category").agg(F.sum("tenths").cast("bigint").alias("affected"))
    share = F.lit(100.0) * (F.lit(1.0) - F.coalesce("affected", F.lit(0)) / (F.col("population") * 10.0))
    score = F.when(F.col("population") > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.floor(share + 0.5)))).cast("bigint")
    return populations.join(affected, "category", "left").select("category", F.coalesce("affected", F.lit(0)).cast("bigint").alias("affected"), F.col("population").cast("bigint").alias("population"), score.alias("score"))
