"""Registered queries on named scans, preferences, small mutations and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import dates, stats
from tideline.plans import oracles
from tideline.schema import THRESHOLDS
from tideline.sources import store, tables
from tideline.sources.scratch import shared_dir
from tideline.sources.tables import read
from tideline.streaming import daily

DAY, SINCE = "2024-01-10", "2024-01-20"


def _check_ins(s, d) -> DataFrame:  # type: ignore[no-untyped-def]
    return store.stamped(tables.check_ins(read(s, d, "events")))


def _shown(c: DataFrame) -> DataFrame:
    return c.select("id", "day", "mood", "energy")


def scan_newest(s, d):
    return _shown(store.newest_first(_check_ins(s, d)))


def scan_day(s, d):
    return _shown(store.newest_first(_check_ins(s, d), DAY))


def scan_oldest_since(s, d):
    return _shown(store.oldest_first(_check_ins(s, d), SINCE))


def _metrics(s, d) -> DataFrame:  # type: ignore[no-untyped-def]
    return tables.diary(read(s, d, "orders"), read(s, d, "lineitem")).select("day", F.round("sleep_minutes", 6).alias("sleep_minutes"), F.round("steps", 6).alias("steps"), "unlock_count")


def scan_metrics(s, d):
    return store.days_in_order(_metrics(s, d))


def metric_of_day(s, d):
    return store.days_in_order(_metrics(s, d), "1997-03-12")


def _tags(s, d) -> DataFrame:  # type: ignore[no-untyped-def]
    """Brands as tags, in an order of their own; every third is switched off."""
    p = read(s, d, "part").groupBy(F.lower("p_brand").alias("name")).agg(F.max("p_size").cast("int").alias("sort_order"), (F.min("p_partkey") % 3 > 0).alias("enabled"))
    return p


def scan_tags(s, d):
    return store.tags_in_order(_tags(s, d))


def enabled_tags(s, d):
    return store.enabled_tags(_tags(s, d))


def tag_count(s, d):
    return store.count_tags(_tags(s, d))


def upsert_tags(s, d):
    """Switched-off tags go, those of small parts move to the end under their own name."""
    t = _tags(s, d)
    kept = store.delete_tags(t, t.filter("NOT enabled"))
    return store.upsert_tags(kept, t.filter("sort_order < 49").select("name", (F.col("sort_order") + 100).alias("sort_order"), F.lit(True).alias("enabled")))


def preferences(s, d):
    """Preferences stored from the events' counts; the others have their defaults."""
    n = read(s, d, "events").agg(F.count(F.lit(1)).alias("n"), F.max("user_id").alias("u"))
    stored = n.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (("reminder_hour", F.col("n") % 24), ("midday_reminder_enabled", F.col("u") > 0), ("other", F.col("n")))])))
    return store.preferences(stored)


def deleted_all(s, d):
    c = _check_ins(s, d)
    kept, tags = store.delete_all(c.select("id"), c.select(F.col("id").alias("check_in_id"), "tag"))
    return kept.unionByName(tags.select(F.col("check_in_id").alias("id")))


def charted(s, d):
    base = tables.demo_series(tables.diary(read(s, d, "orders"), read(s, d, "lineitem")))[1]
    return store.charted(base).groupBy("metric_key").agg(F.count(F.lit(1)).alias("days"))


def first_of_user(s, d):
    return store.first_of(read(s, d, "events"), "user_id", 7, ["ts", "event_id"]).select("event_id", "event_type")


def day_header(s, d):
    days = read(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", dates.day_header(F.col("day")).alias("header"))


def rotation_draws(s, d):
    """The offset that each event's number draws for a series as long as its value."""
    n = (F.floor("value") + 20).cast("long")
    m = stats.rotation_margin(n)
    e = read(s, d, "events").select("event_id", "event_type", n.alias("n"), m.alias("m"))
    return e.select("event_id", (F.col("m") + F.pmod(stats.mixed_draw(THRESHOLDS.seed, F.col("event_type"), F.col("event_id")), F.col("n") - 2 * F.col("m"))).cast("long").alias("offset"))


def _stream(s, d) -> DataFrame:  # type: ignore[no-untyped-def]
    schema = read(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _folder(s) -> str:  # type: ignore[no-untyped-def]
    return f"{shared_dir(s)}/tideline-stream-{uuid.uuid4().hex}"


def stream_daily_means(s, d):
    """Days that the watermark has closed, a week behind the newest event."""
    folder = _folder(s)
    events = _stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    found = daily.daily_means(events, ["event_type"]).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start(f"{folder}/out")
    found.awaitTermination()
    return s.read.schema("event_type string, day date, value double").parquet(f"{folder}/out").select("event_type", "day", F.round("value", 6).alias("value"))


def stream_upserts(s, d):
    """The latest event of each user and type, kept by a stream."""
    folder = _folder(s)
    events = _stream(s, d).select("user_id", "event_type", "event_id", "value")
    daily.upserted(events, f"{folder}/rows", ["user_id", "event_type"], "event_id", f"{folder}/check", buckets=16).awaitTermination()
    return daily.latest_rows(events, f"{folder}/rows").read("rows")


NAMES = (
    scan_newest, scan_day, scan_oldest_since, scan_metrics, metric_of_day, scan_tags, enabled_tags, tag_count, upsert_tags, preferences, deleted_all, charted, first_of_user, day_header, rotation_draws, stream_daily_means, stream_upserts,
)


def oracle_sql() -> dict[str, str]:
    shown = f"WITH {oracles.CHECK} SELECT id, day, mood, energy FROM c"
    metrics = f"WITH {oracles.DIARY} SELECT day, round(sleep_minutes, 6) AS sleep_minutes, round(steps, 6) AS steps, CAST(unlock_count AS INTEGER) AS unlock_count FROM diary"
    tags = "WITH t AS (SELECT lower(p_brand) AS name, CAST(max(p_size) AS INTEGER) AS sort_order, min(p_partkey) % 3 > 0 AS enabled FROM part GROUP BY 1)"
    return {
        "scan_newest": shown,
        "scan_day": f"{shown} WHERE day = DATE '{DAY}'",
        "scan_oldest_since": f"{shown} WHERE day >= DATE '{SINCE}'",
        "scan_metrics": metrics,
        "metric_of_day": f"{metrics} WHERE day = DATE '1997-03-12'",
        "scan_tags": f"{tags} SELECT * FROM t",
        "enabled_tags": f"{tags} SELECT name FROM t WHERE enabled",
        "tag_count": f"{tags} SELECT count(*) AS n FROM t",
        "upsert_tags": f"{tags} SELECT name, CASE WHEN sort_order < 49 THEN sort_order + 100 ELSE sort_order END AS sort_order, true AS enabled FROM t WHERE enabled OR sort_order < 49",
        "preferences": "SELECT true AS reminder_enabled, CAST(count(*) % 24 AS INTEGER) AS reminder_hour, 0 AS reminder_minute, max(user_id) > 0 AS midday_reminder_enabled, 13 AS midday_reminder_hour, 23 AS late_night_hour FROM events",
        "deleted_all": "SELECT event_id AS id FROM events WHERE false",
        "charted": f"WITH {oracles.DIARY} SELECT metric_key, count(v) AS days FROM (SELECT unnest(['sleep_minutes', 'screen_minutes', 'unlock_count', 'steps']) AS metric_key, unnest([sleep_minutes, screen_minutes, unlock_count, steps]) AS v FROM diary) GROUP BY 1",
        "first_of_user": "SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts, event_id LIMIT 1",
        "day_header": "SELECT day, strftime(day, '%A %-d %B') AS header FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)",
        "rotation_draws": f"""WITH e AS (SELECT event_id, CAST(floor(value) AS BIGINT) + 20 AS n, {oracles.mix(f"xor({oracles.seed_of('event_type')}, event_id)", "g")} FROM events)
SELECT event_id, greatest(3, n // 20) + g % (n - 2 * greatest(3, n // 20)) AS "offset" FROM e""",
        "stream_daily_means": """SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS value FROM events GROUP BY event_type, CAST(ts AS DATE)
HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 7 DAY FROM events)""",
        "stream_upserts": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
    }
