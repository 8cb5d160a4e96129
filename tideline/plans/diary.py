"""Registered queries on a diary's raw events, sleep, cycles and weekly rhythm, with their SQL.

The given events stand for phone usage: views and clicks open an app, purchases and sign-ups close one, errors are
unlocks. They are moved by 70 days into a month in which clocks change, forward in Berlin and back in Sydney.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import asof, periodicity, usage
from tideline.plans import oracles
from tideline.schema import THRESHOLDS
from tideline.sources import export, store, tables
from tideline.sources.cache import ResultCache
from tideline.sources.diary_store import DiaryStore
from tideline.sources.imports import TABLES, DiaryExport
from tideline.sources.scratch import shared_dir
from tideline.sources.tables import read
from tideline.sources.usage_store import UsageStore

ZONES, MOVED = ("UTC", "Europe/Berlin", "Australia/Sydney"), 70


def usage_events(events: DataFrame) -> DataFrame:
    zone = F.get(F.array(*map(F.lit, ZONES)), (F.col("user_id") % 3).cast("int"))
    kind = F.when(F.col("event_type").isin("view", "click"), "open").when(F.col("event_type") == "error", "unlock").otherwise("close")
    ts = F.col("ts").cast("timestamp") + F.make_dt_interval(days=F.lit(MOVED))
    return events.select(F.col("user_id").cast("string").alias("subject_id"), zone.alias("zone_id"), ts.alias("ts"), "event_id", F.concat(F.lit("app"), (F.col("event_id") % 3).cast("string")).alias("app"), kind.alias("kind"))


def _social(events: DataFrame) -> DataFrame:
    """Each user's social media: app0, for odd users app1 as well."""
    apps = F.when(F.col("user_id") % 2 == 1, F.array(F.lit("app0"), F.lit("app1"))).otherwise(F.array(F.lit("app0")))
    return events.select("user_id").distinct().select(F.col("user_id").cast("string").alias("subject_id"), F.explode(apps).alias("app"))


def _r(c: Column | str, name: str) -> Column:
    return F.round(c, 6).alias(name)


def usage_intervals(s, d):
    found = usage.foreground(usage_events(read(s, d, "events")))
    return found.select("subject_id", "app", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "lost")


def usage_minutes(s, d):
    e = read(s, d, "events")
    found = usage.daily_usage(usage_events(e), _social(e))
    return found.select("subject_id", "day", *[_r(c, c) for c in ("screen_minutes", "social_media_minutes", "late_night_screen_minutes")], "unlock_count")


def sleep_proxy(s, d):
    found = usage.sleep_proxy(usage.touches(usage_events(read(s, d, "events"))))
    return found.select("subject_id", "day", F.unix_micros("sleep_start").alias("sleep_start"), F.unix_micros("sleep_end").alias("sleep_end"), _r("sleep_minutes", "sleep_minutes"))


def sleep_by_source(s, d):
    """The proxy's nights, sign-ups as wearable sessions, some purchases as manual nights, errors as manual waking."""
    e = read(s, d, "events")
    own = usage_events(e).join(e.select("event_id", "value", "event_type"), "event_id")
    length = lambda c: F.make_dt_interval(secs=F.floor("value") * c)
    claim = lambda rows, start, end, source, asleep: rows.select("subject_id", "zone_id", start.alias("start"), end.alias("end"), F.lit(source).alias("source"), F.lit(asleep).alias("asleep"))
    ts = F.col("ts")
    claims = claim(own.filter("event_type = 'signup'"), ts - length(360), ts, "wearable", True)
    claims = claims.unionByName(claim(own.filter("event_type = 'purchase' AND event_id % 5 = 0"), ts - length(300), ts, "manual", True))
    claims = claims.unionByName(claim(own.filter("event_type = 'error'"), ts, ts + length(120), "manual", False))
    zones = own.groupBy("subject_id").agg(F.max("zone_id").alias("zone_id"))
    proxy = usage.sleep_proxy(usage.touches(usage_events(e))).join(zones, "subject_id")
    found = usage.sleep_by_source(claims.unionByName(claim(proxy, F.col("sleep_start"), F.col("sleep_end"), "proxy", True)))
    return found.select("subject_id", "day", F.unix_micros("sleep_start").alias("sleep_start"), F.unix_micros("sleep_end").alias("sleep_end"), _r("sleep_minutes", "sleep_minutes"), "sleep_source")


def asof_view(s, d):
    """Each purchase with the last view of its user before it; events of a month are sorted by themselves."""
    e = read(s, d, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    seen = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    found = asof.asof_join(bought, seen, ["user_id"], "ts", "at", ["view_id", "view_value"], F.date_trunc("week", "__time"))
    return found.select("user_id", "event_id", "view_id", _r("view_value", "view_value"))


def cycle_phase(s, d):
    """Order days of each nation's market segments as days, those of urgent orders as the starts of cycles."""
    customers = read(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("subject_id"))
    orders = read(s, d, "orders").join(customers, "o_custkey").select("subject_id", F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    starts = orders.filter("o_orderpriority = '1-URGENT'").select("subject_id", F.col("day").alias("start"))
    return asof.cycle_phase(orders.select("subject_id", "day").distinct(), starts).select("subject_id", "day", "cycle_day", "usual", "phase")


def _user_days(events: DataFrame) -> DataFrame:
    """The daily mean and count of each user's events."""
    e = events.groupBy(F.col("user_id").cast("string").alias("subject_id"), F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).cast("double").alias("count"))
    return e.select("subject_id", "day", F.inline(F.array(*[F.struct(F.lit(k).alias("metric_key"), F.col(k).alias("value")) for k in ("mean", "count")])))


def weekly_periodicity(s, d):
    found = periodicity.weekly(_user_days(read(s, d, "events")))
    return found.select("subject_id", "metric_key", "days", "pairs", *[_r(c, c) for c in ("effect", "null_sd", "p")])


def _folder(spark) -> str:  # type: ignore[no-untyped-def]
    return f"{shared_dir(spark)}/tideline-store-{uuid.uuid4().hex}"


def usage_refresh(s, d):
    """The daily table after two batches, the second out of order with the first."""
    e = read(s, d, "events")
    rows = usage_events(e)
    kept = UsageStore(s, _folder(s), _social(e))
    for k in (0, 1):
        kept.ingest(rows.filter(F.col("event_id") % 2 == k), k)
    return kept.daily().select("subject_id", "day", *[_r(c, c) for c in ("screen_minutes", "social_media_minutes", "late_night_screen_minutes")], "unlock_count")


def result_cache(s, d):
    """Weekly rhythm from a cache that first knew a third of the users until 20 January only."""
    schema = "subject_id STRING, metric_key STRING, days INT, pairs INT, effect DOUBLE, null_sd DOUBLE, p DOUBLE"
    series_ = _user_days(read(s, d, "events"))
    cache = ResultCache(s, _folder(s), schema, lambda inputs: periodicity.weekly(inputs["series"]), str(THRESHOLDS))
    cache.refresh({"series": series_.filter((F.col("subject_id").cast("long") % 3 > 0) | (F.col("day") <= F.lit("2024-01-20").cast("date")))})
    cache.refresh({"series": series_})
    return cache.results().select("subject_id", "metric_key", "days", "pairs", *[_r(c, c) for c in ("effect", "null_sd", "p")])


def diary_save(s, d):
    """Check-ins with tags after two saves of both tables."""
    c = tables.check_ins(read(s, d, "events"))
    kept = DiaryStore(s, _folder(s), 16)
    first, second = c.filter("id % 2 = 0"), c.filter("id % 3 = 0").withColumns({"mood": F.lit(3), "note": F.lit("  "), "tag": F.lit("new")})
    for changes in (first, second):
        kept.save(changes.drop("tag"), changes.select(F.col("id").alias("check_in_id"), "tag"))
    now = kept.versions.current()
    return store.with_tags(kept.check_ins(now), kept.tags(now)).select("id", "day", "mood", "energy", "note", F.concat_ws(";", "tags").alias("tags"))


def export_read_back(s, d):
    """Each user's export, written and read again through the data source."""
    c = store.stamped(tables.check_ins(read(s, d, "events"))).withColumn("subject_id", F.col("user_id").cast("string"))
    own = c.withColumn("tags", F.array("tag"))
    empty = s.createDataFrame([], TABLES["daily_metric"].replace("document STRING, position INT", "subject_id STRING"))
    folder = _folder(s)
    export.write_documents(own, empty, 0, folder)
    s.dataSource.register(DiaryExport)
    found = s.read.format("diary_export").option("table", "check_in").load(folder)
    return found.select(F.unix_millis("ts").alias("ts"), "zone_id", "day", "mood", "energy", "note", F.concat_ws(";", "tags").alias("tags"))


NAMES = (usage_intervals, usage_minutes, sleep_proxy, sleep_by_source, asof_view, cycle_phase, weekly_periodicity, usage_refresh, result_cache, diary_save, export_read_back)


def local(t: str) -> str:
    """Wall time of an instant in the zone numbered ``z``."""
    return (
        f"({t} + CASE z WHEN 0 THEN INTERVAL 0 HOUR WHEN 1 THEN CASE WHEN {t} < TIMESTAMP '2024-03-31 01:00:00' THEN INTERVAL 1 HOUR ELSE INTERVAL 2 HOUR END "
        f"ELSE CASE WHEN {t} < TIMESTAMP '2024-04-06 16:00:00' THEN INTERVAL 11 HOUR ELSE INTERVAL 10 HOUR END END)"
    )


def instant(wall: str) -> str:
    """The instant of a wall time, which no change of clocks skips or repeats."""
    return (
        f"(CASE z WHEN 0 THEN {wall} WHEN 1 THEN CASE WHEN {wall} - INTERVAL 1 HOUR < TIMESTAMP '2024-03-31 01:00:00' THEN {wall} - INTERVAL 1 HOUR ELSE {wall} - INTERVAL 2 HOUR END "
        f"ELSE CASE WHEN {wall} - INTERVAL 11 HOUR < TIMESTAMP '2024-04-06 16:00:00' THEN {wall} - INTERVAL 11 HOUR ELSE {wall} - INTERVAL 10 HOUR END END)"
    )


def _day(t: str) -> str:
    return f"CAST({local(f'({t} - INTERVAL 4 HOUR)')} AS DATE)"


def _start(day: str) -> str:
    return f"({instant(f'CAST({day} AS TIMESTAMP)')} + INTERVAL 4 HOUR)"


_END = "least(other, closed)"
_EVENTS = f"""
u0 AS (SELECT CAST(user_id AS VARCHAR) AS subject_id, user_id % 3 AS z, user_id, ts + INTERVAL {MOVED} DAY AS ts, event_id, 'app' || (event_id % 3) AS app,
  CASE WHEN event_type IN ('view', 'click') THEN 'open' WHEN event_type = 'error' THEN 'unlock' ELSE 'close' END AS kind FROM events),
u1 AS (SELECT *, min(CASE WHEN kind IN ('open', 'off') THEN ts END) OVER (PARTITION BY subject_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS other,
  min(CASE WHEN kind = 'close' THEN ts END) OVER (PARTITION BY subject_id, app ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closed FROM u0),
iv AS (SELECT subject_id, z, user_id, app, ts AS s, coalesce({_END} IS NULL OR {_END} > ts + INTERVAL 4 HOUR, true) AS lost, CASE WHEN {_END} <= ts + INTERVAL 4 HOUR THEN {_END} ELSE ts + INTERVAL 4 HOUR END AS e FROM u1 WHERE kind = 'open')"""
_US = "(epoch_us({1}) - epoch_us({0}))"


_SILENCE = f"""t AS (SELECT subject_id, z, s, e FROM iv UNION ALL SELECT subject_id, z, ts, ts FROM u0),
n0 AS (SELECT *, CAST(unnest(generate_series(CAST(CAST({local("s")} AS DATE) AS TIMESTAMP), CAST(CAST({local("e")} AS DATE) + 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM t),
n1 AS (SELECT *, {instant("(CAST(day AS TIMESTAMP) - INTERVAL 3 HOUR)")} AS dusk, {instant("(CAST(day AS TIMESTAMP) + INTERVAL 10 HOUR)")} AS dawn FROM n0),
n2 AS (SELECT subject_id, day, dusk, dawn, greatest(s, dusk) AS s, least(e, dawn) AS e FROM n1 WHERE s < dawn AND (e > dusk OR (s = e AND s >= dusk))),
n3 AS (SELECT subject_id, day, s AS until, coalesce(max(e) OVER (PARTITION BY subject_id, day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), dusk) AS since FROM n2
  UNION ALL SELECT subject_id, day, max(dawn), max(e) FROM n2 GROUP BY subject_id, day),
n4 AS (SELECT *, row_number() OVER (PARTITION BY subject_id, day ORDER BY epoch_us(until) - epoch_us(since) DESC, since) AS k FROM n3)"""


def oracle_sql() -> dict[str, str]:
    found = {
        "usage_intervals": f"WITH {_EVENTS} SELECT subject_id, app, epoch_us(s) AS start, epoch_us(e) AS \"end\", lost FROM iv",
        "usage_minutes": f"""WITH {_EVENTS},
d0 AS (SELECT *, CAST(unnest(generate_series(CAST({_day("s")} AS TIMESTAMP), CAST({_day("(e - INTERVAL 1 MICROSECOND)")} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM iv WHERE s < e),
d1 AS (SELECT *, greatest(s, {_start("day")}) AS a, least(e, {_start("(day + 1)")}) AS b, {instant("(CAST(day AS TIMESTAMP) + INTERVAL 23 HOUR)")} AS late FROM d0),
d2 AS (SELECT subject_id, day, {_US.format("a", "b")} AS m, CASE WHEN app = 'app0' OR (app = 'app1' AND user_id % 2 = 1) THEN {_US.format("a", "b")} ELSE 0 END AS social, greatest(0, {_US.format("greatest(a, late)", "b")}) AS late, NULL AS unlocked FROM d1
  UNION ALL SELECT subject_id, {_day("ts")}, 0, 0, 0, CASE WHEN kind = 'unlock' THEN ts END FROM u0)
SELECT subject_id, day, round(CAST(sum(m) AS DOUBLE) / 60000000, 6) AS screen_minutes, round(CAST(sum(social) AS DOUBLE) / 60000000, 6) AS social_media_minutes, round(CAST(sum(late) AS DOUBLE) / 60000000, 6) AS late_night_screen_minutes, CAST(count(DISTINCT unlocked) AS INTEGER) AS unlock_count FROM d2 GROUP BY ALL""",
        "sleep_proxy": f"WITH {_EVENTS}, {_SILENCE} SELECT subject_id, day, epoch_us(since) AS sleep_start, epoch_us(until) AS sleep_end, round({_US.format("since", "until")} / 60000000.0::DOUBLE, 6) AS sleep_minutes FROM n4 WHERE k = 1",
        "sleep_by_source": f"""WITH {_EVENTS}, {_SILENCE},
v AS (SELECT u0.*, value, event_type FROM u0 JOIN events USING (event_id)),
c AS (SELECT subject_id, z, ts - to_seconds(CAST(floor(value) * 360 AS BIGINT)) AS s, ts AS e, 2 AS rank, 1 AS sleep FROM v WHERE event_type = 'signup'
  UNION ALL SELECT subject_id, z, ts - to_seconds(CAST(floor(value) * 300 AS BIGINT)), ts, 1, 1 FROM v WHERE event_type = 'purchase' AND event_id % 5 = 0
  UNION ALL SELECT subject_id, z, ts, ts + to_seconds(CAST(floor(value) * 120 AS BIGINT)), 1, 0 FROM v WHERE event_type = 'error'
  UNION ALL SELECT subject_id, z, since, until, 3, 1 FROM n4 JOIN (SELECT DISTINCT subject_id, z FROM u0) USING (subject_id) WHERE k = 1),
a AS (SELECT *, CAST({local("e")} AS DATE) AS day FROM c WHERE s < e AND sleep = 1),
b AS (SELECT subject_id, day, min(rank) AS best FROM a GROUP BY ALL),
w AS (SELECT *, CAST(unnest(generate_series(CAST(CAST({local("s")} AS DATE) AS TIMESTAMP), CAST(CAST({local("e")} AS DATE) + 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM c WHERE s < e AND sleep = 0),
x AS (SELECT a.* FROM a JOIN b USING (subject_id, day) WHERE rank = best UNION ALL SELECT w.* FROM w JOIN b USING (subject_id, day) WHERE rank <= best),
t2 AS (SELECT subject_id, day, unnest([s, e]) AS tm FROM x),
t3 AS (SELECT subject_id, day, tm, lead(tm) OVER (PARTITION BY subject_id, day ORDER BY tm) AS nxt FROM (SELECT DISTINCT * FROM t2)),
t4 AS (SELECT t3.*, (SELECT count(*) FROM x WHERE x.subject_id = t3.subject_id AND x.day = t3.day AND x.s <= t3.tm AND x.e >= t3.nxt AND sleep = 1) AS y,
  (SELECT count(*) FROM x WHERE x.subject_id = t3.subject_id AND x.day = t3.day AND x.s <= t3.tm AND x.e >= t3.nxt AND sleep = 0) AS n FROM t3 WHERE nxt IS NOT NULL),
t5 AS (SELECT subject_id, day, min(epoch_us(tm)) AS sleep_start, max(epoch_us(nxt)) AS sleep_end, sum(epoch_us(nxt) - epoch_us(tm)) AS m FROM t4 WHERE y > 0 AND n = 0 GROUP BY ALL)
SELECT subject_id, day, sleep_start, sleep_end, round(CAST(coalesce(m, 0) AS DOUBLE) / 60000000, 6) AS sleep_minutes, ['manual', 'wearable', 'proxy'][best] AS sleep_source FROM b LEFT JOIN t5 USING (subject_id, day)""",
        "asof_view": """WITH v AS (SELECT user_id, ts AS at, max(struct_pack(id := event_id, v := value)) AS last FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT p.user_id, event_id, last.id AS view_id, round(last.v, 6) AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.at""",
        "cycle_phase": """WITH o AS (SELECT c_nationkey || '-' || c_mktsegment AS subject_id, CAST(o_orderdate AS DATE) AS day, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
st AS (SELECT *, start - lag(start) OVER (PARTITION BY subject_id ORDER BY start) AS days FROM (SELECT DISTINCT subject_id, day AS start FROM o WHERE o_orderpriority = '1-URGENT')),
le AS (SELECT *, coalesce(quantile_cont(CASE WHEN days <= 60 THEN days END, 0.5) OVER (PARTITION BY subject_id ORDER BY start ROWS UNBOUNDED PRECEDING), 28.0) AS usual FROM st),
j AS (SELECT d.subject_id, d.day, CAST(d.day - start + 1 AS INTEGER) AS n, usual FROM (SELECT DISTINCT subject_id, day FROM o) d ASOF LEFT JOIN le ON d.subject_id = le.subject_id AND d.day >= le.start)
SELECT subject_id, day, n AS cycle_day, usual, CASE WHEN n <= 5 THEN 'menstrual' WHEN abs(n - (usual - 14)) <= 2 THEN 'ovulatory' WHEN n > usual - 14 THEN 'luteal' WHEN n IS NOT NULL THEN 'follicular' END AS phase
FROM (SELECT subject_id, day, CASE WHEN n <= 60 THEN n END AS n, CASE WHEN n <= 60 THEN usual END AS usual FROM j)""",
        "weekly_periodicity": f"""WITH ud AS (SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(ts AS DATE) AS day, avg(value) AS mean, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL),
se AS (SELECT subject_id, 'mean' AS metric_key, day, mean AS value, 0 AS weekend FROM ud UNION ALL SELECT subject_id, 'count', day, n, 0 FROM ud),
lo AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY subject_id, metric_key) AS days FROM se) WHERE days >= {THRESHOLDS.min_days_lagged}),
{oracles.adjust("lo", "fit", "subject_id, metric_key", "value", "res", False)},
r AS (SELECT *, CAST(day - DATE '1970-01-01' AS BIGINT) AS dn, row_number() OVER w AS pos, (day - min(day) OVER (PARTITION BY subject_id, metric_key)) // {periodicity.BLOCK} AS stretch FROM fit WINDOW w AS (PARTITION BY subject_id, metric_key ORDER BY day)),
pr AS (SELECT a.subject_id, a.metric_key, a.days, a.pos AS pa, b.pos AS pb, a.res AS ra, b.res AS rb FROM r a JOIN r b ON a.subject_id = b.subject_id AND a.metric_key = b.metric_key AND b.day = a.day - {periodicity.LAG}),
ef AS (SELECT subject_id, metric_key, count(*) AS pairs, {oracles.pearson("ra", "rb")} AS effect FROM pr GROUP BY ALL),
k0 AS (SELECT subject_id, metric_key, draw, {oracles.mix(f"xor({oracles.seed_of("subject_id || '|weekly:' || metric_key")}, CAST(draw AS BIGINT))", "h")} FROM (SELECT DISTINCT subject_id, metric_key FROM r), range({THRESHOLDS.null_samples}) AS d(draw)),
k1 AS (SELECT subject_id, metric_key, draw, stretch, dn, res, {oracles.mix("xor(h, dn)", "key")} FROM k0 JOIN r USING (subject_id, metric_key)),
k2 AS (SELECT subject_id, metric_key, draw, res, row_number() OVER (PARTITION BY subject_id, metric_key, draw ORDER BY stretch, key, dn) AS pos FROM k1),
k3 AS (SELECT a.subject_id, a.metric_key, a.draw, {oracles.pearson("a.res", "b.res")} AS c FROM pr JOIN k2 a ON a.subject_id = pr.subject_id AND a.metric_key = pr.metric_key AND a.pos = pa
  JOIN k2 b ON b.subject_id = a.subject_id AND b.metric_key = a.metric_key AND b.draw = a.draw AND b.pos = pb GROUP BY ALL),
nu AS (SELECT subject_id, metric_key, CASE WHEN count(c) >= {THRESHOLDS.null_samples // 2} AND stddev_samp({oracles.fz("c")}) > 1e-12 THEN stddev_samp({oracles.fz("c")}) END AS null_sd FROM k3 GROUP BY ALL),
un AS (SELECT DISTINCT r.subject_id, r.metric_key, CAST(r.days AS INTEGER) AS days, CAST(coalesce(pairs, 0) AS INTEGER) AS pairs, CASE WHEN pairs >= {THRESHOLDS.min_days_same_day} THEN effect END AS effect,
  CASE WHEN pairs >= {THRESHOLDS.min_days_same_day} THEN null_sd END AS null_sd FROM r LEFT JOIN ef USING (subject_id, metric_key) LEFT JOIN nu USING (subject_id, metric_key))
SELECT subject_id, metric_key, days, pairs, round(effect, 6) AS effect, round(null_sd, 6) AS null_sd, round(CASE WHEN effect IS NOT NULL AND null_sd IS NOT NULL THEN {oracles.pval(oracles.fz("effect"), "null_sd")} END, 6) AS p FROM un""",
        "diary_save": f"""WITH {oracles.CHECK} SELECT id, day, CASE WHEN id % 3 = 0 THEN 3 ELSE mood END AS mood, energy, CASE WHEN id % 6 = 0 THEN '  ' WHEN id % 3 = 0 THEN NULL ELSE note END AS note,
  CASE WHEN id % 3 = 0 THEN 'new' ELSE tag END AS tags FROM c WHERE id % 2 = 0 OR id % 3 = 0""",
        "export_read_back": f"WITH {oracles.CHECK} SELECT epoch_us(ts) // 1000 AS ts, zone_id, day, mood, energy, note, tag AS tags FROM c",
    }
    return found | {"usage_refresh": found["usage_minutes"], "result_cache": found["weekly_periodicity"]}
