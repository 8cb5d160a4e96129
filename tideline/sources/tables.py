"""Reading series from tables, and the demonstration generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.dates import is_weekend
from tideline.functions.stats import gaussian, uniform
from tideline.functions.text import clamp_scale
from tideline.operators.series import daily_mean, unpivot_metrics
from tideline.operators.windows import sleep_debt
from tideline.schema import DEFAULT_TAGS, METRICS, THRESHOLDS


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def instant(ts: Column) -> Column:
    """A stored local timestamp, taken as UTC."""
    return ts.cast("timestamp")


def event_series(events: DataFrame, by_user: bool = False) -> DataFrame:
    """Daily mean value of each event type, for all users together or for each."""
    subject = F.col("user_id").cast("string") if by_user else F.lit("all")
    rows = events.select(subject.alias("subject_id"), F.col("event_type").alias("metric_key"), F.col("ts").cast("date").alias("day"), "value")
    return daily_mean(rows, ["subject_id", "metric_key"], "day", F.col("value"))


def check_ins(events: DataFrame) -> DataFrame:
    """Events as check-ins of three time zones, with mood from the value and energy from the user."""
    zone = F.get(F.array(*map(F.lit, ("UTC", "America/New_York", "Asia/Tokyo"))), (F.col("user_id") % 3).cast("int"))
    return events.select(
        F.col("event_id").alias("id"), instant(F.col("ts")).alias("ts"), zone.alias("zone_id"), F.col("user_id"), clamp_scale((F.col("value") - 50) / 20).alias("mood"), clamp_scale((F.col("value") - 30) / 15).alias("energy"), F.col("event_type").alias("tag"), F.col("props").alias("note")
    )


def default_tags(spark: SparkSession) -> DataFrame:
    """The tags of a new store, in order."""
    return spark.createDataFrame([(n, k, True) for k, n in enumerate(DEFAULT_TAGS)], "name string, sort_order int, enabled boolean")


def metric_labels(spark: SparkSession) -> DataFrame:
    """(metric_key, label, position): the order in which outcomes and predictors are examined."""
    known = [("mood", "Mood"), ("energy", "Energy"), *[(k, label) for k, label, _ in METRICS], ("sleep_debt_3d", "3-day sleep debt")]
    return spark.createDataFrame([(k, label, i) for i, (k, label) in enumerate(known)], "metric_key string, label string, position int")


def diary(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The given orders as diaries of years, a row a day: stored metrics, mood, energy and tags.

    Metrics are the day's lines and orders against their year; a night of which the lines are a multiple of eleven was not
    measured. Energy follows sleep two nights before, mood weekends and days on which an urgent order was the largest.
    """
    day = F.col("o_orderdate").cast("date")
    o = orders.groupBy(day.alias("day")).agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).alias("n"), F.max_by("o_orderpriority", F.struct("o_totalprice", "o_orderkey")).alias("top"))
    lines = lineitem.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.count(F.lit(1)).alias("lines"))
    df = o.join(lines, "day", "left").withColumn("subject_id", F.year("day").cast("string"))
    year = Window.partitionBy("subject_id")
    z = lambda c: F.coalesce(F.round((F.col(c) - F.avg(c).over(year)) / F.nullif(F.stddev_samp(c).over(year), F.lit(0.0)), 6), F.lit(0.0))
    df = df.withColumns({f"z_{c}": z(c) for c in ("price", "n", "quantity", "discount", "tax")})
    before = Window.partitionBy("subject_id").orderBy(F.unix_date("day")).rangeBetween(-2, -2)
    df = df.withColumn("driver", F.coalesce(F.max("z_quantity").over(before), F.lit(0.0)))
    seen = F.col("lines").isNotNull()
    urgent = (F.col("top") == "1-URGENT").cast("int")
    return df.select(
        "subject_id",
        "day",
        clamp_scale(F.round(is_weekend(F.col("day")).cast("int") - 1.4 * urgent + 0.8 * F.col("z_price"), 6)).alias("mood"),
        clamp_scale(F.round(0.9 * F.col("driver") + 0.7 * F.col("z_n"), 6)).alias("energy"),
        F.array(F.lower("top")).alias("tags"),
        F.when(seen & (F.col("lines") % 11 > 0), F.round(420 + 55 * F.col("z_quantity"), 6)).alias("sleep_minutes"),
        F.when(seen, F.round(250 + 60 * F.col("z_discount"), 6)).alias("screen_minutes"),
        F.lit(None).cast("double").alias("social_media_minutes"),
        F.col("lines").cast("int").alias("unlock_count"),
        F.when(F.col("z_tax") > -1, F.round(7000 + 2500 * F.col("z_tax"), 6)).alias("steps"),
    )


def demo(spark: SparkSession, subjects: int | DataFrame = 1, days: int = 121, seed: int = THRESHOLDS.seed, start: str = "2026-01-05") -> DataFrame:
    """One row per subject, of a table of them or so many, and day, with known effects: sleep two nights before and drinking the day before move energy, sleep and weekends move mood.

    Draws are hashes of (seed, subject, day, name); what depends on earlier days does so by lags, so subjects are made in parallel.
    """
    if isinstance(subjects, int):
        subjects = spark.range(subjects).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("subject_id"))
    base = subjects.select("subject_id", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("i"))
    base = base.withColumn("day", F.date_add(F.lit(start).cast("date"), F.col("i"))).withColumn("weekend", is_weekend(F.col("day")))

    def u(name: str) -> Column:
        return uniform(seed, F.col("subject_id"), F.col("i"), F.lit(name))

    def g(name: str) -> Column:
        return F.round(gaussian(seed, F.col("subject_id"), F.col("i"), F.lit(name)), 6)

    w = Window.partitionBy("subject_id").orderBy("i")
    df = base.withColumn("drank", (F.col("weekend") & (u("d1") < 0.55)) | (u("d2") < 0.08))
    df = df.withColumn("drank_before", F.coalesce(F.lag("drank").over(w), F.lit(False)).cast("int"))
    we = F.col("weekend").cast("int")
    df = df.withColumn("sleep_minutes", F.round(420 + g("sleep") * 55 + we * 35 - F.col("drank_before") * 25, 6))
    driver = F.coalesce((F.lag("sleep_minutes", 2).over(w) - 420) / 55, F.lit(0.0))
    df = df.withColumn("driver", F.round(driver, 6))
    caffeine, exercise, social = u("t1") < 0.4, u("t2") < 0.3, F.col("weekend") & (u("t3") < 0.6)
    tags = F.filter(F.array(F.when(F.col("drank"), F.lit("alcohol")), F.when(caffeine, F.lit("caffeine")), F.when(exercise, F.lit("exercise")), F.when(social, F.lit("social contact"))), lambda x: x.isNotNull())
    return df.select(
        "subject_id",
        "i",
        "day",
        clamp_scale(F.round(0.4 * F.col("driver") + we * 1.0 + 0.8 * g("mood"), 6)).alias("mood"),
        clamp_scale(F.round(0.9 * F.col("driver") - 1.1 * F.col("drank_before") + 0.7 * g("energy"), 6)).alias("energy"),
        tags.alias("tags"),
        "sleep_minutes",
        F.round(300 + g("screen") * 80 + we * 60, 6).alias("screen_minutes"),
        F.round(70 + g("social") * 30, 6).alias("social_media_minutes"),
        F.greatest(F.lit(0.0), F.round(20 + g("late") * 15, 6)).alias("late_night_screen_minutes"),
        F.greatest(F.lit(0), F.floor(F.round(70 + g("unlock") * 20, 6) + 0.5)).cast("int").alias("unlock_count"),
        F.greatest(F.lit(0.0), F.round(7000 + g("steps") * 2500, 6)).alias("steps"),
        F.when(exercise, F.round(35 + g("exercise") * 12, 6)).otherwise(0.0).alias("exercise_minutes"),
    )


def demo_series(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, predictors, tag days) of the demonstration rows; sleep debt is among the predictors."""
    outcome = F.array(*[F.struct(F.lit(k).alias("metric_key"), F.col(k).cast("double").alias("value")) for k in ("mood", "energy")])
    outcomes = df.select("subject_id", "day", F.inline(outcome)).select("subject_id", "metric_key", "day", "value")
    base = unpivot_metrics(df, ["subject_id"])
    return outcomes, with_sleep_debt(base), df.select("subject_id", F.explode("tags").alias("tag"), "day").distinct()


def with_sleep_debt(base: DataFrame) -> DataFrame:
    """Adds the three-day sleep debt to the predictors of subjects with enough nights."""
    debt = sleep_debt(base.filter("metric_key = 'sleep_minutes'"), ["subject_id"])
    return base.unionByName(debt.select("subject_id", F.lit("sleep_debt_3d").alias("metric_key"), "day", F.col("debt").alias("value")))
