"""CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import csv_cell

# The header line, the sentence on the scale, and below the names of fields in a document.
HEADER = "date,timestamp_utc,zone,mood,energy,tags,note"
SCALE = "mood and energy are integers on a -3..+3 scale"


def csv_lines(check_ins: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``line``: the CSV line of each check-in; tags are sorted and joined by semicolons, cells quoted where they must be."""
    cells = [F.col("day").cast("string"), F.unix_millis("ts").cast("string"), F.col("zone_id"), F.col("mood").cast("string"), F.col("energy").cast("string"), F.concat_ws(";", F.array_sort("tags")), F.coalesce("note", F.lit(""))]
    return check_ins.select(*(extra or []), "ts", F.concat_ws(",", *map(csv_cell, cells)).alias("line"))


def write_csv(check_ins: DataFrame, path: str) -> None:
    """Text files in order of time; the header comes from ``HEADER``, as a line of the first file."""
    lines = csv_lines(check_ins).select(F.struct(F.lit(1).alias("part"), "ts").alias("o"), "line")
    head = check_ins.sparkSession.createDataFrame([(HEADER,)], "line string").select(F.struct(F.lit(0).alias("part"), F.lit(None).cast("timestamp").alias("ts")).alias("o"), "line")
    head.unionByName(lines).repartitionByRange("o").sortWithinPartitions("o").select("line").write.text(path)


def check_in_json(check_ins: DataFrame) -> DataFrame:
    """``json``: each check-in as an object, nulls kept."""
    row = F.struct(F.unix_millis("ts").alias("timestampUtc"), F.col("zone_id").alias("zoneId"), F.col("day").cast("string").alias("localDate"), "mood", "energy", "note", F.array_sort("tags").alias("tags"))
    return check_ins.select("id", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def metric_struct() -> F.Column:
    # Field and column.
    names = (("screenMinutes", "screen_minutes"), ("socialMediaMinutes", "social_media_minutes"), ("lateNightScreenMinutes", "late_night_screen_minutes"), ("unlockCount", "unlock_count"), ("sleepMinutes", "sleep_minutes"), ("sleepSource", "sleep_source"), ("steps", "steps"), ("exerciseMinutes", "exercise_minutes"), ("restingHeartRate", "resting_hr"), ("hrv", "hrv"))
    return F.struct(F.col("day").cast("string").alias("localDate"), *[F.col(c).alias(k) for k, c in names])


def json_document(check_ins: DataFrame, metrics: DataFrame, exported_at: int, pretty: bool = True) -> DataFrame:
    """One subject's export as one document; the columns ``subject_id`` of both tables part subjects."""
    c = check_ins.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_millis("ts").alias("timestampUtc"), F.col("zone_id").alias("zoneId"), F.col("day").cast("string").alias("localDate"), "mood", "energy", "note", F.array_sort("tags").alias("tags")))).alias("checkIns"))
    m = metrics.groupBy("subject_id").agg(F.array_sort(F.collect_list(metric_struct())).alias("dailyMetrics"))
    doc = F.struct(F.lit(1).alias("schemaVersion"), F.lit(exported_at).alias("exportedAtUtc"), F.lit(SCALE).alias("scale"), F.coalesce("checkIns", F.array()).alias("checkIns"), F.coalesce("dailyMetrics", F.array()).alias("dailyMetrics"))
    return c.join(m, "subject_id", "full_outer").select("subject_id", F.to_json(doc, {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("json"))


def write_documents(check_ins: DataFrame, metrics: DataFrame, exported_at: int, path: str) -> None:
    """One document a line, in text files that the data source ``diary_export`` reads."""
    json_document(check_ins, metrics, exported_at, pretty=False).select("json").write.text(path)
