"""Mutations of the stored tables as rewrites: tables in, new tables out."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.dates import local_day
from tideline.functions.text import clean_tag
from tideline.schema import Settings


def stamped(new: DataFrame) -> DataFrame:
    """Check-ins with their local day, a note of white space only being none. Notes are kept untrimmed."""
    return new.withColumns({"day": local_day(F.col("ts"), F.col("zone_id")), "note": F.when(F.col("note").rlike(r"\S"), F.col("note"))})


def save_check_ins(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Updates mood, energy and note of known ids and appends the others; time, zone and day of known ones stay."""
    c = changes.select(F.col("id").alias("__id"), *[F.col(x).alias(f"__{x}") for x in ("mood", "energy", "note")])
    there = F.col("__id").isNotNull()
    updated = stored.join(c, stored["id"] == F.col("__id"), "left").select(*[F.when(there, F.col(f"__{x}")).otherwise(F.col(x)).alias(x) if x in ("mood", "energy", "note") else F.col(x) for x in stored.columns])
    return updated.unionByName(stamped(changes).join(stored.select("id"), "id", "left_anti").select(*stored.columns))


def replace_tags(stored: DataFrame, changes: DataFrame, touched: DataFrame) -> DataFrame:
    """Tags of touched check-ins are those of ``changes``, each once."""
    ids = touched.select(F.col("id").alias("check_in_id"))
    return stored.join(ids, "check_in_id", "left_anti").unionByName(changes.select("check_in_id", "tag").distinct())


def delete_check_ins(check_ins: DataFrame, tags: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletes check-ins, and their tags with them."""
    return check_ins.join(ids, "id", "left_anti"), tags.join(ids.select(F.col("id").alias("check_in_id")), "check_in_id", "left_anti")


def upsert_latest(stored: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: that with the greatest ``order``; of equals, the change."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("__new")))
    return both.withColumn("__n", n).filter("__n = 1").drop("__n", "__new")


def delete_all(*tables: DataFrame) -> tuple[DataFrame, ...]:
    return tuple(t.limit(0) for t in tables)


def newest_first(check_ins: DataFrame, day: object = None) -> DataFrame:
    """Check-ins, of one day if given, the newest first."""
    own = check_ins if day is None else check_ins.filter(F.col("day") == F.lit(day).cast("date"))
    return own.orderBy(F.desc("ts"), F.desc("id"))


def oldest_first(check_ins: DataFrame, since: object = None) -> DataFrame:
    """Check-ins, from a day on if given, the oldest first."""
    own = check_ins if since is None else check_ins.filter(F.col("day") >= F.lit(since).cast("date"))
    return own.orderBy("ts", "id")


def days_in_order(daily: DataFrame, day: object = None) -> DataFrame:
    """Daily rows in order of days; of one day at most one row, none where it is not known."""
    return daily.orderBy("day") if day is None else daily.filter(F.col("day") == F.lit(day).cast("date")).limit(1)


def tags_in_order(tags: DataFrame) -> DataFrame:
    return tags.orderBy("sort_order", "name")


def enabled_tags(tags: DataFrame) -> DataFrame:
    return tags_in_order(tags.filter("enabled")).select("name")


def count_tags(tags: DataFrame) -> DataFrame:
    return tags.agg(F.count(F.lit(1)).alias("n"))


def upsert_tags(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Tags of ``changes``, of different names, replace those of the same name."""
    return delete_tags(stored, changes).unionByName(changes)


def delete_tags(stored: DataFrame, names: DataFrame) -> DataFrame:
    return stored.join(names.select("name"), "name", "left_anti").select(*stored.columns)


def first_of(rows: DataFrame, key: str, value: object, order: list[str]) -> DataFrame:
    """The first row of a key, in ``order``, or none."""
    return rows.filter(F.col(key) == F.lit(value)).orderBy(*order).limit(1)


def charted(rows: DataFrame) -> DataFrame:
    """Metrics that charts show: all but the derived sleep debt."""
    return rows.filter(F.col("metric_key") != "sleep_debt_3d")


def preferences(stored: DataFrame) -> DataFrame:
    """Stored (key, value) preferences as one row of all settings; those not stored have their defaults."""
    columns = [F.coalesce(F.max(F.when(F.col("key") == f.name, F.col("value"))).try_cast(_KINDS[type(f.default)]), F.lit(f.default)).alias(f.name) for f in fields(Settings)]
    return stored.agg(*columns)


_KINDS = {bool: "boolean", int: "int", float: "double", str: "string"}


def add_tags(stored: DataFrame, names: DataFrame) -> DataFrame:
    """Trimmed, lower-cased, new and not empty names go last."""
    new = names.select(clean_tag(F.col("name")).alias("name")).filter("name <> ''").distinct()
    return stored.join(new, "name", "left_anti").unionByName(new.select("name", F.lit(2147483647).alias("sort_order"), F.lit(True).alias("enabled")))


def with_tags(check_ins: DataFrame, tags: DataFrame) -> DataFrame:
    """Check-ins with their tags as a sorted array, empty without any."""
    own = tags.groupBy(F.col("check_in_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return check_ins.join(own, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
