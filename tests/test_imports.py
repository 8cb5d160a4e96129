"""Exported documents read back."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tideline.sources import export
from tideline.sources.imports import LISTS, TABLES, DiaryExport

METRICS = TABLES["daily_metric"].replace("document STRING, position INT", "subject_id STRING")


def load(spark, path, table, **options):
    spark.dataSource.register(DiaryExport)
    return spark.read.format("diary_export").option("table", table).options(**options).load(str(path))


def test_export_and_read_back(spark, tmp_path):
    at = lambda k: dt.datetime(2024, 1, 1, 9, 30, 15, 123000, tzinfo=dt.UTC) + dt.timedelta(hours=7 * k)
    rows = [(f"s{k % 3}", at(k), "Asia/Tokyo", dt.date(2024, 1, 1) + dt.timedelta(days=k // 4), k % 7 - 3, 3 - k % 7, None if k % 2 else 'say "hi",\nü', [] if k % 5 else ["b", "a"]) for k in range(40)]
    c = spark.createDataFrame(rows, "subject_id string, ts timestamp, zone_id string, day date, mood int, energy int, note string, tags array<string>")
    m = spark.createDataFrame([(f"s{k % 2}", dt.date(2024, 1, k + 1), k / 3, None, 0.0, k, None, "proxy" if k % 2 else None, 1e4, None, 55.5, None) for k in range(9)], METRICS)
    out = export.json_document(c, m, 5).collect()
    for r in out:
        (tmp_path / f"{r['subject_id']}.json").write_text(r["json"])
    read = load(spark, tmp_path, "check_in", partitionBytes="10")
    assert read.rdd.getNumPartitions() == 3 and [f.simpleString() for f in read.schema] == [f.simpleString() for f in type(read.schema).fromDDL(TABLES["check_in"])]
    own = F.regexp_replace("document", ".json$", "").alias("subject_id")
    columns = ["ts", "zone_id", "day", "mood", "energy", "note"]
    got = read.select(own, *columns, F.array_sort("tags").alias("tags"))
    want = c.select("subject_id", *columns, F.array_sort("tags").alias("tags"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    metrics = load(spark, f"file://{tmp_path}", "daily_metric").select(own, *[x for x in m.columns if x != "subject_id"])
    assert sorted(map(str, metrics.collect())) == sorted(map(str, m.collect())) and load(spark, tmp_path, "problems").count() == 0
    names = [f.rstrip("*") for _, fields in LISTS.values() for f, _ in fields]
    assert set(names) == set(json.loads(out[0]["json"])["checkIns"][0]) | {f.name for f in m.select(export.metric_struct().alias("s")).schema["s"].dataType}


def test_broken_and_strange_documents(spark, tmp_path):
    good = {"timestampUtc": 0, "zoneId": "UTC", "localDate": "1970-01-01", "mood": 1, "energy": 2}
    docs = {
        "a.json": {"checkIns": [{**good, "extra": {"x": 1}}, {**good, "mood": "high"}, {**good, "mood": 2.0}, {**good, "mood": True}, {"zoneId": "UTC"}, 7, {**good, "localDate": "yesterday"}, {**good, "tags": "x"}, {**good, "timestampUtc": 10**18}], "more": 1},
        "b.json": {"schemaVersion": 2, "checkIns": [good]},
        "c.json": [good],
        "d.json": {"checkIns": {"no": "list"}, "dailyMetrics": [{"localDate": "2024-02-30"}, {"localDate": "2024-02-29", "steps": None}]},
        "e.json": {"schemaVersion": 1},
    }
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc))
    (tmp_path / "f.json").write_text('{"checkIns": [')
    (tmp_path / "g.json").write_text("")
    (tmp_path / "h.jsonl").write_text("\n".join(["", json.dumps({"checkIns": [good]}), "{broken}", json.dumps({"checkIns": [{**good, "note": None, "tags": None}]}), ""]))
    (tmp_path / "_SUCCESS").write_text("")
    got = {(r["document"], r["position"], r["mood"], tuple(r["tags"])) for r in load(spark, tmp_path, "check_in").collect()}
    assert got == {("a.json", 0, 1, ()), ("a.json", 2, 2, ()), ("h.jsonl:2", 0, 1, ()), ("h.jsonl:4", 0, 1, ())}
    assert [(r["document"], str(r["day"])) for r in load(spark, tmp_path, "daily_metric").collect()] == [("d.json", "2024-02-29")]
    problems = {(r["document"], r["position"]) for r in load(spark, tmp_path, "problems").collect()}
    assert problems == {("a.json", k) for k in (1, 3, 4, 5, 6, 7, 8)} | {("b.json", None), ("c.json", None), ("d.json", None), ("d.json", 0), ("f.json", None), ("h.jsonl:3", None)}
    with pytest.raises(Exception, match="mood|object|no "):
        load(spark, tmp_path, "check_in", mode="FAILFAST").collect()
    (tmp_path / "none").mkdir()
    assert load(spark, tmp_path / "none", "check_in").count() == 0
    for path, table in ((tmp_path / "missing", "check_in"), (tmp_path, "tags")):
        with pytest.raises(Exception, match="missing|table"):
            load(spark, path, table).collect()
