"""The analysis on planted truth, exports and the streaming forms."""

import json

import pytest
from pyspark.sql import functions as F

from tideline.plans import engine
from tideline.schema import Settings
from tideline.sources import export, store, tables
from tideline.streaming import daily


def test_planted_effects_are_found(spark):
    report = engine.analyse(*tables.demo_series(tables.demo(spark, 1)), tables.metric_labels(spark))
    found = {r["test_id"]: r for r in report.insights.collect()}
    lagged = found["corr:energy:sleep_minutes:lag2"]
    assert lagged["confidence"] == "CLEAR" and lagged["effect"] > 0 and lagged["ci_low"] < lagged["effect"] < lagged["ci_high"]
    assert lagged["headline"] == "Sleep 2 days earlier tracks higher energy" and "not evidence of cause" in lagged["detail"]
    assert report.tests.count() == 86 and report.pending.count() == 0
    assert [r["place"] for r in report.insights.orderBy("place").collect()] == list(range(1, len(found) + 1))
    assert all(df.storageLevel.useMemory for df in report.persisted) and len(report.persisted) == 4
    report.release()
    assert not any(df.storageLevel.useMemory or df.storageLevel.useDisk for df in report.persisted)


def test_short_history_is_pending(spark):
    df = tables.demo(spark, 1, days=10)
    report = engine.analyse(*tables.demo_series(df), tables.metric_labels(spark))
    assert report.insights.count() == 0
    left = {r["id"]: r["days_remaining"] for r in report.pending.collect()}
    assert left == {"same_day": 4, "lagged": 11, "day_of_week": 32}


def test_exports(spark, tmp_path):
    rows = [("s", 2, "2024-01-02T05:00:00", "UTC", 1, -1, "say \"hi\", you", ["b", "a"]), ("s", 1, "2024-01-01T03:00:00", "UTC", 0, 2, "  ", [])]
    c = spark.createDataFrame(rows, "subject_id string, id long, ts string, zone_id string, mood int, energy int, note string, tags array<string>").withColumn("ts", F.col("ts").cast("timestamp"))
    c = store.stamped(c)
    export.write_csv(c, str(tmp_path / "csv"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert sorted(lines) == sorted([export.HEADER, '2024-01-02,1704171600000,UTC,1,-1,a;b,"say ""hi"", you"', "2023-12-31,1704078000000,UTC,0,2,,"])
    metrics = spark.createDataFrame([("s", "2024-01-01", 1.0)], "subject_id string, day string, steps double").withColumn("day", F.col("day").cast("date"))
    empty = {k: F.lit(None).cast("double") for k in ("screen_minutes", "social_media_minutes", "late_night_screen_minutes", "sleep_minutes", "exercise_minutes", "resting_hr", "hrv")}
    metrics = metrics.withColumns(empty | {"unlock_count": F.lit(None).cast("int"), "sleep_source": F.lit(None).cast("string")})
    doc = json.loads(export.json_document(c, metrics, 5).first()["json"])
    assert [x["tags"] for x in doc["checkIns"]] == [[], ["a", "b"]] and doc["checkIns"][0]["note"] is None
    assert doc["dailyMetrics"][0]["steps"] == 1.0 and doc["dailyMetrics"][0]["hrv"] is None and doc["schemaVersion"] == 1


def test_defaults():
    assert Settings().reminder_hour == 21 and Settings().late_night_hour == 23


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", "2024-01-01T01:00:00", 1.0, 1), ("a", "2024-01-01T09:00:00", 3.0, 2), ("a", "2024-02-01T00:00:00", 9.0, 3)]
    spark.createDataFrame(rows, "k string, ts string, value double, version int").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(src))
    stream = spark.readStream.schema("k string, ts timestamp, value double, version int").parquet(str(src))
    query = daily.upserted(stream, str(tmp_path / "out"), ["k"], "version", str(tmp_path / "c1"))
    query.awaitTermination(60)
    assert [r["version"] for r in daily.latest_rows(stream, str(tmp_path / "out")).read("rows").collect()] == [3]
    query = daily.daily_means(stream, ["k"]).writeStream.format("memory").queryName("means").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(str(r["day"]), r["value"]) for r in spark.table("means").collect()} == {("2024-01-01", 2.0)}


def test_own_statistic_transform_and_draws(spark):
    import numpy as np

    from tideline.operators import nulls
    from tideline.operators.resample import gathered
    from tideline.schema import Thresholds

    r = np.random.default_rng(1)
    t = Thresholds(null_samples=40, replicates=60, exact_null_days=10)
    rows = spark.createDataFrame([("t", k, 0, float(r.normal()), float(r.normal()), int(k % 3 == 0)) for k in range(60)], "test_id string, n int, weekend int, x double, ry double, inside int")
    rows = rows.selectExpr("test_id", "date_add(DATE'2024-01-01', n) AS day", "weekend", "x", "ry", "x AS rx", "inside")
    packed = gathered(rows, ["test_id"], ["weekend", "x", "rx", "ry", "inside"])
    first = lambda df, c: df.first()[c]
    twice = first(nulls.rotation_null(packed, ["test_id"], t, statistic=lambda a, b: 2 * nulls.rank_correlations(a, b), transform=lambda x: x), "null_sd")
    once = first(nulls.rotation_null(packed, ["test_id"], t, transform=lambda x: x), "null_sd")
    assert twice == pytest.approx(2 * once)
    assert nulls.rotation_null(packed, ["test_id"], t, draw=lambda seed, test, k: np.zeros(len(k), np.int64)).first()["null_sd"] is None  # one rotation has no spread
    means = first(nulls.block_null(packed, ["test_id"], t, statistic=lambda v, g: v[:, :10].mean(1)), "null_sd")
    assert 0.1 < means < 0.7
    own = first(nulls.bootstrap_error(packed, ["test_id"], False, t, statistic=lambda a, b: (a * b).mean(1)), "se")
    assert own is not None and own != first(nulls.bootstrap_error(packed, ["test_id"], False, t), "se")


def test_summary_says_when_nothing_stands_out(spark):
    tests = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "subject_id string, k int")
    found = spark.createDataFrame([("a", "CLEAR"), ("a", "TENTATIVE"), ("a", "CLEAR")], "subject_id string, confidence string")
    waits = spark.createDataFrame([("c", "sleep"), ("d", "sleep")], "subject_id string, id string")
    got = {r["subject_id"]: tuple(r)[1:] for r in engine.summary(engine.Report(tests, found, waits)).collect()}
    assert got == {"a": (2, 2, 1, 0, None), "b": (1, 0, 0, 0, "Nothing stands out yet"), "c": (1, 0, 0, 1, None), "d": (0, 0, 0, 1, None)}
