"""Making, uniting and aligning daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.dates import is_weekend
from tideline.schema import METRICS


def daily_mean(rows: DataFrame, keys: list[str], day: str, value: Column, name: str = "value") -> DataFrame:
    """Mean of the observations of a day; a day without any has no row."""
    return rows.groupBy(*keys, day).agg(F.avg(value).alias(name)).filter(F.col(name).isNotNull())


def last_wins(points: DataFrame, keys: list[str], day: str, value: str, order: str) -> DataFrame:
    """One value per day: that with the greatest ``order``."""
    return points.groupBy(*keys, day).agg(F.max_by(value, order).alias(value))


def tag_days(tagged: DataFrame, keys: list[str], tag: str = "tag", day: str = "day") -> DataFrame:
    return tagged.select(*keys, tag, day).distinct()


def unpivot_metrics(wide: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """The wide metric table as long series; what was not observed has no row."""
    names = [k for k, _, _ in METRICS if k in wide.columns]
    pairs = F.array(*[F.struct(F.lit(k).alias("metric_key"), F.col(k).cast("double").alias("value")) for k in names])
    return wide.select(*keys, day, F.inline(pairs)).filter(F.col("value").isNotNull()).select(*keys, "metric_key", day, "value")


def lag_align(outcomes: DataFrame, predictors: DataFrame, max_lag: int = 3) -> DataFrame:
    """outcome on day d beside predictor on day d - lag, for every pair and lag 0 to ``max_lag``, in calendar days.

    The lags multiply the predictor's rows before one equi-join on (subject, day); no pair without both sides remains.
    """
    o = outcomes.select("subject_id", F.col("metric_key").alias("outcome"), "day", F.col("value").alias("y"))
    p = predictors.select("subject_id", F.col("metric_key").alias("predictor"), F.col("day").alias("seen"), F.col("value").alias("x"))
    p = p.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).withColumn("day", F.date_add("seen", F.col("lag"))).drop("seen")
    return o.join(p, ["subject_id", "day"]).select("subject_id", "outcome", "predictor", "lag", "day", "y", "x", is_weekend(F.col("day")).cast("int").alias("weekend"))


def indicator(outcomes: DataFrame, tags: DataFrame) -> DataFrame:
    """Every outcome day beside every tag of its subject: inside (1) or not (0)."""
    names = tags.select("subject_id", "tag").distinct()
    days = tags.select("subject_id", "tag", "day", F.lit(1).alias("inside")).distinct()
    o = outcomes.select("subject_id", F.col("metric_key").alias("outcome"), "day", F.col("value").alias("y"))
    return o.join(names, "subject_id").join(days, ["subject_id", "tag", "day"], "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
