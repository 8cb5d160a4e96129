"""Correcting a family of tests. Every family is one subject's, unless other keys are given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bh_threshold(tests: DataFrame, keys: list[str], p: str = "p", q: float = 0.10) -> DataFrame:
    """Adds ``family``, the tests of the key, and ``bh``: the largest p that the step-up procedure accepts, or null."""
    w = Window.partitionBy(*keys)
    k = F.row_number().over(w.orderBy(p))
    tests = tests.withColumns({"family": F.count(F.lit(1)).over(w), "__k": k})
    return tests.withColumn("bh", F.max(F.when(F.col(p) <= F.col("__k") / F.col("family") * q, F.col(p))).over(w)).drop("__k")


def tiers(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Adds ``confidence``: CLEAR within the family-wise level, TENTATIVE within the false-discovery threshold, else null."""
    return tests.withColumn(
        "confidence", F.when(F.col("bh").isNull() | (F.col(p) > F.col("bh")), F.lit(None)).when(F.col(p) <= alpha / F.greatest(F.lit(1), F.col("family")), "CLEAR").otherwise("TENTATIVE")
    )


def strongest(found: DataFrame, keys: list[str], pair: str, score: str, ordinal: str) -> DataFrame:
    """The best of each pair; the earlier candidate wins ties."""
    w = Window.partitionBy(*keys, pair).orderBy(F.desc(score), ordinal)
    return found.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
