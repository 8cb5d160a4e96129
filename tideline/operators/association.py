"""The tests: lagged rank correlations and group comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.dates import is_weekend
from tideline.functions.stats import pearson
from tideline.operators.nulls import adjusted_rows, examined
from tideline.operators.resample import gathered
from tideline.operators.residuals import adjusted
from tideline.operators.series import indicator, lag_align
from tideline.operators.windows import average_rank
from tideline.schema import THRESHOLDS, WEEKDAYS, Thresholds

PAIR = ["subject_id", "outcome", "predictor", "lag"]
GROUP = ["subject_id", "outcome", "grp"]


def correlation_id(outcome: Column, predictor: Column, lag: Column) -> Column:
    return F.concat(F.lit("corr:"), outcome, F.lit(":"), predictor, F.lit(":lag"), lag.cast("string"))


def correlation_kind(predictor: Column, lag: Column) -> Column:
    return F.when(predictor.startswith("sleep_debt"), "SLEEP_DEBT").when(lag == 0, "SAME_DAY").otherwise("LAGGED")


def correlation_rows(outcomes: DataFrame, predictors: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """Aligned days of every test that passes its gate, with both sides adjusted by windows: rx, ry."""
    pairs = lag_align(outcomes, predictors, t.max_lag)
    n = F.count(F.lit(1)).over(Window.partitionBy(*PAIR))
    pairs = pairs.withColumn("n", n).filter(F.col("n") >= F.when(F.col("lag") == 0, t.min_days_same_day).otherwise(t.min_days_lagged))
    pairs = pairs.withColumn("test_id", correlation_id(F.col("outcome"), F.col("predictor"), F.col("lag")))
    return adjusted(adjusted(pairs, PAIR, "y", "ry", window=t.detrend_window), PAIR, "x", "rx", window=t.detrend_window)


def spearman(rows: DataFrame, keys: list[str], x: str = "rx", y: str = "ry", name: str = "effect") -> DataFrame:
    ranked = rows.withColumns({"__qx": average_rank(x, keys), "__qy": average_rank(y, keys)})
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"), pearson(F.col("__qx"), F.col("__qy")).alias(name))


def gathered_pairs(outcomes: DataFrame, predictors: DataFrame, t: Thresholds = THRESHOLDS, only: DataFrame | None = None) -> DataFrame:
    """Aligned and adjusted days of every test that passes its gate, or of those in ``only``, an array row each."""
    pairs = lag_align(outcomes, predictors, t.max_lag)
    if only is not None:
        pairs = pairs.join(only.distinct(), PAIR, "left_semi")
    pairs = pairs.withColumn("test_id", correlation_id(F.col("outcome"), F.col("predictor"), F.col("lag")))
    keys = [*PAIR, "test_id"]
    enough = F.col("n") >= F.when(F.col("lag") == 0, t.min_days_same_day).otherwise(t.min_days_lagged)
    return adjusted_rows(gathered(pairs, keys, ["weekend", "y", "x"]).filter(enough), keys, False, t)


def reverse_checks(outcomes: DataFrame, predictors: DataFrame, t: Thresholds = THRESHOLDS, only: DataFrame | None = None) -> DataFrame:
    """(subject_id, outcome, predictor, lag, reverse): the correlation with the sides swapped, at lags of a day or more.

    ``only``: (subject_id, outcome, predictor, lag) of the tests to be checked; all without it.
    """
    if only is not None:
        side = lambda c: only.select("subject_id", F.col(c).alias("metric_key")).distinct()
        outcomes, predictors = outcomes.join(side("outcome"), ["subject_id", "metric_key"], "left_semi"), predictors.join(side("predictor"), ["subject_id", "metric_key"], "left_semi")
        only = only.select("subject_id", F.col("predictor").alias("outcome"), F.col("outcome").alias("predictor"), "lag")
    swapped = gathered_pairs(predictors, outcomes, t, only).filter("lag > 0")
    found = examined(swapped, [*PAIR, "test_id"], False, t, null=False)
    return found.select("subject_id", F.col("predictor").alias("outcome"), F.col("outcome").alias("predictor"), "lag", F.col("effect").alias("reverse"))


def tag_rows(outcomes: DataFrame, tags: DataFrame) -> DataFrame:
    """Every outcome day beside every tag of its subject; to be adjusted for weekends."""
    rows = indicator(outcomes, tags).withColumnRenamed("tag", "grp")
    return rows.withColumns({"weekend": is_weekend(F.col("day")).cast("int"), "test_id": F.concat(F.lit("tag:"), F.col("outcome"), F.lit(":"), F.col("grp"))})


def weekday_rows(outcomes: DataFrame) -> DataFrame:
    """Seven comparisons per outcome; not adjusted for weekends, which are what they look for."""
    o = outcomes.select("subject_id", F.col("metric_key").alias("outcome"), "day", F.col("value").alias("y"))
    rows = o.withColumn("grp", F.explode(F.array(*map(F.lit, WEEKDAYS))))
    inside = F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday("day")) == F.col("grp")
    return rows.withColumns({"inside": inside.cast("int"), "weekend": F.lit(0), "test_id": F.concat(F.lit("dow:"), F.col("outcome"), F.lit(":"), F.upper("grp"))})


def gathered_groups(rows: DataFrame, least: int, t: Thresholds = THRESHOLDS) -> DataFrame:
    """Adjusted days of every comparison of at least ``least`` days with enough of them on both sides, an array row each."""
    keys = [*GROUP, "test_id"]
    packed = gathered(rows, keys, ["weekend", "y", "inside"]).withColumn("within", F.aggregate("rows", F.lit(0), lambda a, r: a + r["inside"]))
    return adjusted_rows(packed.filter((F.col("n") >= least) & (F.col("within") >= t.min_group) & (F.col("n") - F.col("within") >= t.min_group)), keys, True, t)
