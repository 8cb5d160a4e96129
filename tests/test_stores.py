"""Versioned tables, the result cache, usage days, and the state of a day."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tideline.operators import usage
from tideline.sources.cache import ResultCache, fingerprint
from tideline.sources.diary_store import DiaryStore
from tideline.sources.usage_store import PurgeRefused, UsageStore, stream_usage
from tideline.sources.versions import Conflict, Versions
from tideline.streaming import daily, today

UTC = dt.UTC
NEW = "id long, ts timestamp, zone_id string, mood int, energy int, note string"
TAG = "check_in_id long, tag string"


def files(root):
    return {os.path.join(d, n) for d, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


def check_ins(spark, *rows):
    return spark.createDataFrame([(k, dt.datetime(2024, 1, 1, 12, tzinfo=UTC), "UTC", m, 0, n) for k, m, n in rows], NEW)


def seen(store, manifest=None):
    return sorted((r["id"], r["mood"]) for r in store.check_ins(manifest).collect()), sorted(tuple(r) for r in store.tags(manifest).collect())


def test_check_in_and_tags_change_together(spark, tmp_path, monkeypatch):
    store = DiaryStore(spark, str(tmp_path), buckets=8)
    assert seen(store) == ([], [])
    store.save(check_ins(spark, *[(k, 1, None) for k in range(20)]), spark.createDataFrame([(k, "a") for k in range(20)] + [(99, "other")], TAG))
    before, reader, old_tags = seen(store), store.check_ins(), store.tags()
    on_disk = files(tmp_path)
    # A reader that began before a save goes on with one version of both.
    store.save(check_ins(spark, (3, 2, " "), (20, 3, "n")), spark.createDataFrame([(3, "b"), (3, "b"), (20, "c")], TAG))
    assert sorted((r["id"], r["mood"]) for r in reader.collect()) == before[0] and sorted(tuple(r) for r in old_tags.collect()) == before[1]
    moods, tags = seen(store)
    assert dict(moods)[3] == 2 and dict(moods)[20] == 3 and (3, "b") in tags and (3, "a") not in tags and (20, "c") in tags and len(tags) == 21
    assert seen(store, store.versions.at(1)) == before and on_disk <= files(tmp_path)
    # A save that dies after one table is written changes nothing.
    write = Versions.write

    def dies(self, table, *rest, **more):
        if table == "check_in_tag":
            raise OSError("disk full")
        return write(self, table, *rest, **more)

    monkeypatch.setattr(Versions, "write", dies)
    with pytest.raises(OSError):
        store.save(check_ins(spark, (3, -3, None)), spark.createDataFrame([(3, "z")], TAG))
    monkeypatch.undo()
    assert seen(store) == (moods, tags) and store.versions.current().version == 2
    store.delete(spark.createDataFrame([(3,), (4,), (777,)], "id long"))
    assert 3 not in dict(seen(store)[0]) and 4 not in dict(seen(store)[1])
    assert store.versions.vacuum(keep=1) > 0 and dict(seen(store)[0])[20] == 3 and len(files(tmp_path)) < len(on_disk) * 2
    assert DiaryStore(spark, str(tmp_path), buckets=3).buckets == 8


def test_of_two_saves_one_wins(spark, tmp_path):
    v = Versions(spark, str(tmp_path), {"t": "k long"})
    base = v.current()
    first = v.write("t", spark.range(3).toDF("k"), F.lit("a"))
    v.commit(base, {"t": first})
    with pytest.raises(Conflict):
        v.commit(base, {"t": {}})
    assert v.current().version == 1 and v.read("t").count() == 3 and not [n for n in os.listdir(tmp_path) if n.startswith(".draft")]
    tried = []

    def change(base):
        if not tried:
            v.commit(base, {"t": v.write("t", spark.range(2).toDF("k"), F.lit("b"))})  # another save comes first
        tried.append(base.version)
        return {"t": v.write("t", v.read("t", base).filter("k = 0"), F.lit("c"), ["a", "b"])}, {"n": len(tried)}

    made = v.save(change)
    assert tried == [1, 2] and made.version == 3 and sorted(made.tables["t"]) == ["c"] and v.read("t").count() == 2 and made.notes == {"n": 2}


def test_fingerprint_tells_rows_but_not_order(spark):
    rows = [("a", 1, 2.0), ("a", 2, None), ("b", 1, 2.0)]
    own = lambda rows, parts=2: {r["k"]: r["print"] for r in fingerprint(spark.createDataFrame(rows, "k string, i int, x double").repartition(parts), ["k"]).collect()}
    base = own(rows)
    assert base == own(rows[::-1], 5) and base["a"] != base["b"]
    assert base["a"] != own([("a", 1, 2.0)])["a"] and base["b"] != own([("b", 1, 2.0), ("b", 1, 2.0)])["b"] != own([("b", 1, 2.0)] * 3)["b"]


def test_results_are_computed_for_changed_subjects_only(spark, tmp_path):
    asked = []

    def compute(inputs):
        asked.append(sorted(r[0] for r in inputs["series"].select("subject_id").distinct().collect()))
        return inputs["series"].groupBy("subject_id").agg(F.sum("value").alias("total"))

    def table(**subjects):
        return {"series": spark.createDataFrame([(s, k, float(v)) for s, values in subjects.items() for k, v in enumerate(values)], "subject_id string, day int, value double"), "tags": spark.createDataFrame([("a", "x")], "subject_id string, tag string")}

    def got(cache):
        return {r["subject_id"]: r["total"] for r in cache.results().collect()}

    cache = ResultCache(spark, str(tmp_path), "subject_id STRING, total DOUBLE", compute, "v1")
    assert got(cache) == {}
    assert cache.refresh(table(a=[1, 2], b=[3], c=[4])) == 3 and got(cache) == {"a": 3.0, "b": 3.0, "c": 4.0}
    assert cache.refresh(table(a=[1, 2], b=[3], c=[4])) == 0 and len(asked) == 1  # nothing is computed again
    full = table(a=[1, 2], b=[3, 5], d=[1])
    assert cache.refresh(full) == 2 and asked[-1] == ["b", "d"] and got(cache) == {"a": 3.0, "b": 8.0, "d": 1.0}
    assert got(cache) == {r["subject_id"]: r["total"] for r in compute(full).collect()}
    cache.compact()
    assert got(cache) == {"a": 3.0, "b": 8.0, "d": 1.0} and len(cache.versions.current().tables["results"]) == 1
    other = ResultCache(spark, str(tmp_path), "subject_id STRING, total DOUBLE", compute, "v2")  # other settings
    assert other.refresh(full) == 3
    changed = full | {"tags": full["tags"].union(full["tags"])}
    assert other.refresh(changed) == 1 and asked[-1] == ["a"]


def usage_rows(spark, rows):
    return spark.createDataFrame([("s", "Europe/Berlin", dt.datetime(2024, 5, d, h, m, tzinfo=UTC), k, "app", kind) for k, (d, h, m, kind) in rows.items()], usage.USAGE_EVENT)


SOME = {1: (1, 8, 0, "open"), 2: (1, 9, 0, "close"), 3: (3, 23, 30, "open"), 4: (4, 1, 0, "close"), 5: (6, 10, 0, "open"), 6: (6, 10, 30, "close"), 7: (12, 10, 0, "unlock")}


def minutes_of(store):
    return {str(r["day"]): r["screen_minutes"] for r in store.daily().collect()}


def test_only_touched_days_are_replaced(spark, tmp_path):
    social = spark.createDataFrame([], "subject_id string, app string")
    store = UsageStore(spark, str(tmp_path), social)
    store.ingest(usage_rows(spark, {k: v for k, v in SOME.items() if k != 4}), 0)
    assert minutes_of(store) == {"2024-05-01": 60.0, "2024-05-03": 150.0, "2024-05-04": 90.0, "2024-05-06": 30.0, "2024-05-12": 0.0}  # the close is lost: four hours, cut at 04:00
    before = store.versions.current()
    store.ingest(usage_rows(spark, {4: SOME[4], 2: SOME[2]}), 1)  # the close comes late, another event comes again
    after = store.versions.current()
    assert minutes_of(store) == {"2024-05-01": 60.0, "2024-05-03": 90.0, "2024-05-06": 30.0, "2024-05-12": 0.0}
    untouched = {"2024-05-06", "2024-05-12"}
    assert {d: before.tables["daily_usage"][d] for d in untouched} == {d: after.tables["daily_usage"][d] for d in untouched}
    assert after.tables["daily_usage"]["2024-05-03"] != before.tables["daily_usage"]["2024-05-03"] and store.events().count() == 7
    whole = {(str(r["day"]), r["screen_minutes"], r["unlock_count"]) for r in usage.daily_usage(usage_rows(spark, SOME), social).collect()}
    assert {(str(r["day"]), r["screen_minutes"], r["unlock_count"]) for r in store.daily().collect()} == whole
    assert store.ingest(usage_rows(spark, {9: (1, 1, 1, "unlock")}), 1).version == after.version  # a batch sent again


def test_raw_days_are_purged_only_when_covered(spark, tmp_path):
    store = UsageStore(spark, str(tmp_path), spark.createDataFrame([], "subject_id string, app string"))
    store.ingest(usage_rows(spark, SOME))
    totals = minutes_of(store)
    with pytest.raises(PurgeRefused):
        store.purge("2024-05-07")  # too near to the newest day
    store.append(usage_rows(spark, {20: (1, 20, 0, "open"), 21: (1, 20, 30, "close")}))
    with pytest.raises(PurgeRefused):
        store.purge("2024-05-03")  # stored, not yet in the daily table
    assert store.versions.current().tables["usage_event"].keys() >= {"2024-05-01", "2024-05-03"} and minutes_of(store) == totals
    store.aggregate()
    assert minutes_of(store)["2024-05-01"] == 90.0
    store.purge("2024-05-03")
    assert sorted(store.versions.current().tables["usage_event"]) == ["2024-05-03", "2024-05-04", "2024-05-06", "2024-05-12"] and minutes_of(store)["2024-05-01"] == 90.0
    store.ingest(usage_rows(spark, {30: (1, 5, 0, "unlock"), 31: (12, 11, 0, "open"), 32: (12, 11, 5, "close")}))  # one event too late
    assert minutes_of(store)["2024-05-01"] == 90.0 and minutes_of(store)["2024-05-12"] == 5.0 and store.versions.current().notes["refused"] == 1


def test_usage_stream_and_latest_rows(spark, tmp_path):
    usage_rows(spark, SOME).write.json(str(tmp_path / "in"))
    social = spark.createDataFrame([], "subject_id string, app string")
    store = UsageStore(spark, str(tmp_path / "store"), social)

    def go():
        stream = spark.readStream.schema(usage.USAGE_EVENT).json(str(tmp_path / "in"))
        stream_usage(stream, store, str(tmp_path / "check")).awaitTermination(120)

    go()
    usage_rows(spark, {40: (6, 12, 0, "open"), 41: (6, 12, 15, "close")}).write.mode("append").json(str(tmp_path / "in"))
    go()
    assert minutes_of(store)["2024-05-06"] == 45.0 and store.versions.current().notes["batch"] == 1
    rows = "k long, version long"
    keep = spark.createDataFrame([(k, v) for k in range(30) for v in (1, 2)], rows)
    keep.write.parquet(str(tmp_path / "rows"))

    def upsert():
        source = spark.readStream.schema(rows).parquet(str(tmp_path / "rows"))
        daily.upserted(source, str(tmp_path / "latest"), ["k"], "version", str(tmp_path / "c"), buckets=4).awaitTermination(120)
        return daily.latest_rows(source, str(tmp_path / "latest"))

    table = upsert()
    first = table.current()
    assert sorted(tuple(r) for r in table.read("rows").collect()) == [(k, 2) for k in range(30)] and 1 < len(first.tables["rows"]) <= 4
    spark.createDataFrame([(3, 9), (3, 1)], rows).write.mode("append").parquet(str(tmp_path / "rows"))
    table = upsert()
    assert dict(tuple(r) for r in table.read("rows").collect())[3] == 9
    assert sum(first.tables["rows"][p] != f for p, f in table.current().tables["rows"].items()) == 1  # one bucket is rewritten


def test_state_of_three_tables(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    day, next_week = dt.date(2024, 5, 1), dt.date(2024, 5, 20)
    at = lambda d: dt.datetime.combine(d, dt.time(12), UTC)
    shown: dict = {}

    def feed(rows):
        spark.createDataFrame(rows, today.CHANGE).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        got = []
        stream = today.today(spark.readStream.schema(today.CHANGE).json(str(tmp_path / "in")), keep_days=7)
        query = stream.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        shown.update({(r["subject_id"], r["day"]): (r["entries"], r["tags"], r["metrics"]) for r in got})
        return {(r["subject_id"], r["day"]) for r in got}

    try:
        feed([("a", "check_in", "1", 1, at(day), day, "one", False), ("a", "tag", "x", 1, at(day), None, "2", False), ("a", "tag", "y", 1, at(day), None, "1", False), ("a", "daily_metric", "d", 1, at(day), day, "m", False), ("b", "check_in", "1", 1, at(day), day, "b1", False), (None, "tag", "z", 1, at(day), None, "1", False)])
        assert shown[("a", day)] == (["one"], ["y", "x"], "m") and shown[("b", day)] == (["b1"], [], None)
        # After a restart: a repeated row and a late version change nothing; a new version, a deletion and a switched-off tag do.
        changed = feed([("a", "check_in", "1", 1, at(day), day, "one", False), ("a", "check_in", "2", 5, at(day), day, "two", False), ("a", "check_in", "2", 4, at(day), day, "old", False), ("a", "tag", "y", 2, at(day), None, "1", True), ("b", "check_in", "1", 1, at(day), day, "b1", False)])
        assert changed == {("a", day)} and shown[("a", day)] == (["one", "two"], ["x"], "m")
        feed([("a", "check_in", "1", 2, at(day), day, None, True)])
        assert shown[("a", day)] == (["two"], ["x"], "m")
        # Three weeks on, the day's state has gone: a change of it is ignored, the tags are still there.
        feed([("a", "daily_metric", "e", 1, at(next_week), next_week, "m2", False)])
        assert shown[("a", next_week)] == ([], ["x"], "m2")
        changed = feed([("a", "check_in", "3", 9, at(next_week), day, "late", False), ("a", "tag", "w", 1, at(next_week), None, "0", False)])
        assert changed == {("a", next_week)} and shown[("a", next_week)] == ([], ["w", "x"], "m2") and shown[("a", day)][0] == ["two"]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
