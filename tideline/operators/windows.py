"""Calendar windows over daily series. Days that were not observed neither count nor appear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank from 1; ties share the mean of their places."""
    w = Window.partitionBy(*keys).orderBy(value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2


def _days(keys: list[str], day: str, before: int, after: int):  # type: ignore[no-untyped-def]
    return Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(-before, after)


def centred_mean(value: str, keys: list[str], days: int, day: str = "day") -> Column:
    return F.avg(value).over(_days(keys, day, days // 2, days // 2))


def trailing_mean(df: DataFrame, keys: list[str], value: str = "value", days: int = 7, least: int | None = None, day: str = "day", name: str = "mean") -> DataFrame:
    """Mean of the last ``days`` days, on days that were observed and have ``least`` (half of them by default) observations."""
    w = _days(keys, day, days - 1, 0)
    return df.withColumns({name: F.avg(value).over(w), "seen": F.count(value).over(w)}).filter(F.col("seen") >= (days // 2 if least is None else least)).drop("seen")


def sleep_baseline(df: DataFrame, keys: list[str], value: str = "value", days: int = 28, least: int = 7, day: str = "day") -> DataFrame:
    """Median of the last ``days`` days, this one included, where ``least`` were observed."""
    w = _days(keys, day, days - 1, 0)
    return df.withColumn("baseline", F.when(F.count(value).over(w) >= least, F.percentile(value, 0.5).over(w)))


def sleep_debt(df: DataFrame, keys: list[str], value: str = "value", days: int = 3, baseline_days: int = 28, least_series: int = 14, day: str = "day") -> DataFrame:
    """Shortfall of the last ``days`` nights against the day's own baseline; no value after a missing night or for short series."""
    based = sleep_baseline(df, keys, value, baseline_days, day=day)
    nights = F.collect_list(value).over(_days(keys, day, days - 1, 0))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = based.withColumns({"nights": nights, "size": size}).filter((F.col("size") >= least_series) & (F.size("nights") == days) & F.col("baseline").isNotNull())
    debt = F.aggregate("nights", F.lit(0.0), lambda a, x: a + F.greatest(F.lit(0.0), F.col("baseline") - x))
    return out.select(*keys, day, debt.alias("debt"))


def line_segments(df: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """Numbers runs of consecutive days."""
    w = Window.partitionBy(*keys).orderBy(day)
    broken = F.when(F.datediff(day, F.lag(day).over(w)) == 1, 0).otherwise(1)
    return df.withColumn("broken", broken).withColumn("segment_id", F.sum("broken").over(w)).drop("broken")


def position(keys: list[str], day: str = "day") -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(day)) - 1
