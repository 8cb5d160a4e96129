"""Circular shifts, block permutations and block bootstraps as relations.

A test's days are gathered once, in order, into one array row; draws multiply
that row, and the drawn values come out of it by position. Draws are hashes of
(seed, test, draw, index), so results do not depend on partitions or order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.stats import block_length, mixed_draw


def gathered(df: DataFrame, keys: list[str], columns: list[str], day: str = "day") -> DataFrame:
    """One row per test: ``rows``, an array of (day, columns) in order, and its size ``n``. A test has as many elements as days."""
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(day, *columns))).alias("rows"))
    return packed.withColumn("n", F.size("rows"))


def circular_shift(values: Column, offset: Column) -> Column:
    """Element i is the one ``offset`` places on, around the end."""
    return F.transform(values, lambda _, i: F.get(values, F.pmod(i + offset, F.size(values))))


def block_permuted(packed: DataFrame, keys: list[str], draws: int, seed: int) -> DataFrame:
    """(keys, draw, n, ``values``): the values of each draw in permuted order; needs rows of (day, ry, ...).

    Each place after the first starts a block with probability 1 / mean length; blocks are shuffled whole.
    """
    mean = F.greatest(F.lit(1), F.least(block_length(F.col("n")), F.greatest(F.lit(1), F.floor(F.col("n") / 2)))).cast("double")
    rows = packed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(*keys, "n", "draw", F.posexplode("rows").alias("pos", "r"))
    rows = rows.withColumn("starts", F.when((F.col("pos") == 0) | (mixed_draw(seed, F.col("test_id"), F.col("draw"), F.col("pos")) / 4294967296.0 <= 1 / mean), 1).otherwise(0))
    by = Window.partitionBy(*keys, "draw").orderBy("pos")
    rows = rows.withColumn("block", F.sum("starts").over(by))
    rows = rows.withColumn("place", mixed_draw(seed, F.col("test_id"), F.col("draw"), F.col("block"), F.lit(1)))
    order = F.array_sort(F.collect_list(F.struct("place", "block", "pos", F.col("r.ry").alias("ry"))))
    return rows.groupBy(*keys, "n", "draw").agg(order.alias("o")).select(*keys, "n", "draw", F.transform("o", lambda o: o["ry"]).alias("values"))


def block_bootstrap(packed: DataFrame, keys: list[str], first: str, second: str, replicates: int, seed: int) -> DataFrame:
    """(keys, rep, i, a, b): pairs drawn in blocks with replacement; tests of fewer than six days have none."""
    size = block_length(F.col("n"))
    df = packed.filter("n >= 6").withColumn("size", size).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    starts = F.transform(
        F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("size")).cast("int") - 1),
        lambda b: F.pmod(mixed_draw(seed, F.col("test_id"), F.col("rep"), b), F.col("n") - F.col("size") + 1).cast("int"),
    )
    df = df.withColumn("starts", starts)
    place = lambda i: F.get("starts", F.floor(i / F.col("size")).cast("int")) + i % F.col("size")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("i"), F.get("rows", place(i))[first].alias("a"), F.get("rows", place(i))[second].alias("b")))
    return df.select(*keys, "n", "rep", F.inline(pairs))
