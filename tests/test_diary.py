"""Usage intervals, sleep, as-of joins, cycles and weekly rhythm."""

import datetime as dt
import math
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tideline.operators import asof, periodicity, usage
from tideline.schema import Thresholds

UTC = dt.UTC


def at(zone, *parts, fold=0):
    return dt.datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold).astimezone(UTC)


def events(spark, rows):
    return spark.createDataFrame([(s, z, t, k, a, kind) for k, (s, z, t, a, kind) in enumerate(rows)], usage.USAGE_EVENT).repartition(3)


def minutes(a, b):
    return (b - a).total_seconds() / 60


def plain_intervals(rows, longest=4):
    """By a loop over each subject's events in order."""
    out = []
    for k, (s, _z, t, a, kind) in enumerate(rows):
        if None in (s, t, kind) or kind != "open":
            continue
        later = sorted((u, j) for j, (s2, _, u, a2, kind2) in enumerate(rows) if s2 == s and u is not None and (u, j) > (t, k) and (kind2 in ("open", "off") or (kind2 == "close" and a2 == a)))
        limit = t + dt.timedelta(hours=longest)
        lost = not later or later[0][0] > limit
        out.append((s, a, t, limit if lost else later[0][0], lost))
    return sorted(out, key=str)


def instants(df, *columns):
    return df.select(*[F.unix_micros(c).alias(c) if df.schema[c].dataType.typeName() == "timestamp" else c for c in columns]).collect()


def micros(t):
    return int((t - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))


def test_intervals_match_a_loop(spark):
    r = random.Random(6)
    start = dt.datetime(2024, 3, 30, tzinfo=UTC)
    rows = [(f"s{r.randrange(3)}", "Europe/Berlin", start + dt.timedelta(minutes=r.randrange(4000)), r.choice(["a", "b", None]), r.choice(["open", "open", "close", "unlock", "off"])) for _ in range(300)]
    rows += [("s0", "UTC", None, "a", "open"), (None, "UTC", start, "a", "open"), ("s0", "UTC", start, "a", None)]
    rows += [("edge", "UTC", start - dt.timedelta(hours=1), "a", "open"), ("edge", "UTC", start + dt.timedelta(hours=3), "a", "close")]  # an end exactly as far as looked, over a chunk's edge
    got = [tuple(x) for x in instants(usage.foreground(events(spark, rows)), "subject_id", "app", "start", "end", "lost")]
    assert sorted(got, key=str) == sorted(((s, a, micros(b), micros(e), lost) for s, a, b, e, lost in plain_intervals(rows)), key=str)
    assert usage.foreground(events(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("zone", "opened", "closed", "expected"),
    [
        # Clocks forward in the night to 31 March: 22:30 to 03:30 summer time is four hours; the day changes 4 hours after midnight, at 05:00.
        ("Europe/Berlin", (2024, 3, 30, 22, 30), (2024, 3, 31, 3, 30), {dt.date(2024, 3, 30): (240, 210)}),
        ("Europe/Berlin", (2024, 3, 31, 3, 30), (2024, 3, 31, 6, 0), {dt.date(2024, 3, 30): (90, 90), dt.date(2024, 3, 31): (60, 0)}),
        # Clocks back in the night to 7 April: 23:30 to 02:15 the second time is 3 h 45; the day changes at 03:00.
        ("Australia/Sydney", (2024, 4, 6, 23, 30), (2024, 4, 7, 2, 15, 1), {dt.date(2024, 4, 6): (225, 225)}),
        ("Australia/Sydney", (2024, 4, 7, 1, 0), (2024, 4, 7, 3, 30), {dt.date(2024, 4, 6): (180, 180), dt.date(2024, 4, 7): (30, 0)}),
        ("UTC", (2024, 1, 1, 2, 0), (2024, 1, 1, 5, 0), {dt.date(2023, 12, 31): (120, 120), dt.date(2024, 1, 1): (60, 0)}),
    ],
)
def test_days_and_late_hours_across_clock_changes(spark, zone, opened, closed, expected):
    fold = closed[5] if len(closed) > 5 else 0
    a, b = at(zone, *opened), at(zone, *closed[:5], fold=fold)
    rows = events(spark, [("s", zone, a, "x", "open"), ("s", zone, b, "x", "close")])
    got = {r["day"]: (r["screen_minutes"], r["late_night_screen_minutes"]) for r in usage.daily_usage(rows, spark.createDataFrame([], "subject_id string, app string")).collect()}
    closes_on = (b - dt.timedelta(hours=4)).astimezone(ZoneInfo(zone)).date()
    assert {k: v for k, v in got.items() if v[0] or k not in (closes_on,)} == expected and math.isclose(sum(v[0] for v in got.values()), minutes(a, b))


def test_daily_usage(spark):
    t = lambda h, m=0, d=1: dt.datetime(2024, 5, d, h, m, tzinfo=UTC)
    rows = [
        ("a", "UTC", t(9), "social", "open"), ("a", "UTC", t(9, 30), "maps", "open"), ("a", "UTC", t(9, 40), "social", "close"), ("a", "UTC", t(10), None, "off"), ("a", "UTC", t(10), None, "unlock"), ("a", "UTC", t(10), None, "unlock"),
        ("a", "UTC", t(12, d=3), None, "unlock"), ("b", "UTC", t(12), "social", "open"), ("b", "UTC", t(12, 1), "social", "close"),
    ]
    social = spark.createDataFrame([("a", "social"), ("a", "social"), ("c", "maps")], "subject_id string, app string")
    got = {tuple(r) for r in usage.daily_usage(events(spark, rows), social).collect()}
    day = dt.date(2024, 5, 1)
    assert got == {("a", day, 60.0, 30.0, 0.0, 1), ("a", dt.date(2024, 5, 3), 0.0, 0.0, 0.0, 1), ("b", day, 1.0, 0.0, 0.0, 0)}
    early = usage.split_days(usage.foreground(events(spark, [("a", "UTC", t(0), "x", "open"), ("a", "UTC", t(2), "x", "close")])), late_hour=1)
    assert [(r["day"], r["late_micros"]) for r in early.collect()] == [(dt.date(2024, 4, 30), 60 * usage.MINUTE)]  # an hour after midnight


def night(spark, rows):
    used = spark.createDataFrame(rows, "subject_id string, zone_id string, start timestamp, end timestamp").repartition(2)
    return {(r["subject_id"], r["day"]): (r["sleep_start"], r["sleep_end"], r["sleep_minutes"]) for r in instants(usage.sleep_proxy(used), "subject_id", "day", "sleep_start", "sleep_end", "sleep_minutes")}


def test_sleep_is_the_longest_silence(spark):
    t = lambda h, m=0, d=1: dt.datetime(2024, 5, d, h, m, tzinfo=UTC)
    two = dt.date(2024, 5, 2)
    # Overlapping and nested intervals merge; the day before 21:00 and after 10:00 does not count.
    rows = [("a", "UTC", t(20), t(23)), ("a", "UTC", t(22), t(22, 30)), ("a", "UTC", t(22, 45), t(23, 30)), ("a", "UTC", t(7, d=2), t(7, d=2)), ("a", "UTC", t(9, 30, 2), t(14, d=2))]
    assert night(spark, rows) == {("a", two): (micros(t(23, 30)), micros(t(7, d=2)), 450.0)}
    # Of equal silences the first; the edges of the night bound them.
    rows = [("b", "UTC", t(3, 30, 2), t(3, 30, 2)), ("c", "UTC", t(12), t(12))]
    assert night(spark, rows) == {("b", two): (micros(t(21)), micros(t(3, 30, 2)), 390.0)}  # c used nothing at night: no row
    # A use over a whole night leaves no silence; one over several days belongs to each night.
    got = night(spark, [("d", "UTC", t(20), t(12, d=3))])
    assert {k[1]: v[2] for k, v in got.items()} == {two: 0.0, dt.date(2024, 5, 3): 0.0}
    # Nights of both clock changes: 13 hours less or more one.
    for zone, day, length in (("Europe/Berlin", (2024, 3, 31), 12), ("Australia/Sydney", (2024, 4, 7), 14)):
        end = at(zone, *day, 9, 59)
        assert night(spark, [("e", zone, end, end)])[("e", dt.date(*day))][2] == length * 60 - 1
    assert night(spark, []) == {}


def test_sources_of_sleep(spark):
    t = lambda h, m=0, d=2: dt.datetime(2024, 5, d, h, m, tzinfo=UTC)
    day = dt.date(2024, 5, 2)

    def run(*rows):
        schema = "subject_id string, zone_id string, start timestamp, end timestamp, source string, asleep boolean"
        found = usage.sleep_by_source(spark.createDataFrame([("s", "UTC", *r) for r in rows], schema))
        return {r["day"]: (r["sleep_start"], r["sleep_end"], r["sleep_minutes"], r["sleep_source"]) for r in instants(found, "day", "sleep_start", "sleep_end", "sleep_minutes", "sleep_source")}

    proxy, worn = (t(22, d=1), t(8), "proxy", True), (t(23, d=1), t(7), "wearable", True)
    assert run(proxy) == {day: (micros(t(22, d=1)), micros(t(8)), 600.0, "proxy")}
    assert run(proxy, worn, worn, (t(23, 30, 1), t(6), "wearable", True)) == {day: (micros(t(23, d=1)), micros(t(7)), 480.0, "wearable")}
    manual = (t(1), t(5), "manual", True)
    assert run(proxy, worn, manual)[day] == (micros(t(1)), micros(t(5)), 240.0, "manual")
    # Waking: of a more trusted source it cuts, from over the day's edge too; of a less trusted one it does not.
    assert run(worn, (t(22, d=1), t(1), "manual", False), (t(2), t(2, 30), "wearable", False), (t(3), t(4), "proxy", False))[day] == (micros(t(1)), micros(t(7)), 330.0, "wearable")
    assert run(worn, (t(6), t(9), "manual", False), (t(6, 30), t(10), "manual", False))[day][1:3] == (micros(t(6)), 420.0)
    assert run(worn, (t(20, d=1), t(9), "manual", False)) == {day: (None, None, 0.0, "wearable")}
    assert run((t(1), t(1), "manual", True), (t(5), t(1), "manual", True), (t(1), t(2), "guess", True), (t(1), t(2), "manual", None), (None, t(2), "manual", True), (t(1), t(3), "manual", False)) == {}


def test_asof_join(spark):
    left = spark.createDataFrame([("a", 5, "l1"), ("a", 10, "l2"), ("a", 10, "l2"), ("a", 1, "l3"), ("b", 9, "l4"), (None, 9, "l5"), ("a", None, "l6"), ("a", 30, "l7")], "k string, t int, v string")
    right = spark.createDataFrame([("a", 4, "x", 1), ("a", 10, "y", 1), ("a", 10, "z", 0), ("a", 6, None, None), (None, 1, "n", 1), ("a", None, "m", 1)], "k string, u int, v2 string, w int")
    expected = {("l1", "x", 1), ("l2", "z", 0), ("l3", None, None), ("l4", None, None), ("l5", None, None), ("l6", None, None), ("l7", "z", 0)}
    for bucket in (None, F.floor(F.col("__time") / 4)):
        out = asof.asof_join(left, right, ["k"], "t", "u", ["v2", "w"], bucket)
        assert out.columns == ["k", "t", "v", "v2", "w"] and out.count() == 8
        assert {(r["v"], r["v2"], r["w"]) for r in out.collect()} == expected
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert asof.asof_join(left, right, ["k"], "t", "u", ["v2"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert asof.asof_join(left.limit(0), right, ["k"], "t", "u", ["v2"]).count() == 0
    assert {r["v2"] for r in asof.asof_join(left, right.limit(0), ["k"], "t", "u", ["v2"]).collect()} == {None}


def test_cycle_phase(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    starts = spark.createDataFrame([("a", day(k)) for k in (10, 10, 40, 66, 300)] + [(None, day(0)), ("a", None)], "subject_id string, start date")
    days = spark.createDataFrame([("a", day(k)) for k in (0, 9, 10, 14, 15, 21, 24, 26, 27, 39, 40, 65, 66, 75, 126, 300, 310)] + [("b", day(10))], "subject_id string, day date")
    got = {(r["subject_id"], (r["day"] - day(0)).days): (r["cycle_day"], r["usual"], r["phase"]) for r in asof.cycle_phase(days, starts).collect()}
    none = (None, None, None)
    assert got[("a", 0)] == got[("a", 9)] == got[("b", 10)] == none  # before the first start, or without any
    assert got[("a", 10)] == (1, 28.0, "menstrual") and got[("a", 14)][2] == "menstrual" and got[("a", 15)][2] == "follicular"
    assert got[("a", 21)][2] == "ovulatory" and got[("a", 24)][2] == "ovulatory" and got[("a", 26)] == (17, 28.0, "luteal")
    assert got[("a", 39)] == (30, 28.0, "luteal") and got[("a", 40)] == (1, 30.0, "menstrual")
    assert got[("a", 65)] == (26, 30.0, "luteal") and got[("a", 66)] == (1, 28.0, "menstrual")  # the median of 30 and 26
    assert got[("a", 75)] == (10, 28.0, "follicular") and got[("a", 126)] == none  # more than 60 days after a start
    assert got[("a", 300)] == (1, 28.0, "menstrual") and got[("a", 310)] == (11, 28.0, "follicular")  # a cycle of 234 days is none


def rhythm(spark, subjects, days, weekly, drift, keep=1.0):
    r = random.Random(4)
    rows = []
    for s in range(subjects):
        level = 0.0
        for i in range(days):
            level += r.gauss(0, drift)
            if r.random() < keep:
                rows.append((f"s{s}", "m", dt.date(2024, 1, 1) + dt.timedelta(days=i), weekly * math.sin(2 * math.pi * i / 7) + level + r.gauss(0, 1)))
    return spark.createDataFrame(rows, "subject_id string, metric_key string, day date, value double")


def test_weekly_rhythm_is_found_with_gaps(spark):
    got = periodicity.weekly(rhythm(spark, 20, 120, 1.5, 0.2, 0.8)).collect()
    assert len(got) == 20 and sum(r["effect"] > 0 and r["p"] < 0.05 for r in got) >= 18


def test_noise_and_slow_drift_are_no_rhythm(spark):
    for drift in (0.0, 0.3):
        got = periodicity.weekly(rhythm(spark, 60, 120, 0.0, drift)).collect()
        assert len(got) == 60 and sum(r["p"] < 0.05 for r in got) <= 7


def test_weekly_of_odd_series(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("short", "m", day(k), float(k % 3)) for k in range(20)] + [("flat", "m", day(k), 2.0) for k in range(40)] + [("thin", "m", day(4 * k), float(k % 5)) for k in range(30)] + [("null", "m", day(k), None) for k in range(40)]
    got = {r["subject_id"]: (r["days"], r["pairs"], r["effect"], r["null_sd"], r["p"]) for r in periodicity.weekly(spark.createDataFrame(rows, "subject_id string, metric_key string, day date, value double")).collect()}
    assert got == {"flat": (40, 33, None, None, None), "thin": (30, 0, None, None, None)}
    assert periodicity.weekly(spark.createDataFrame([], "subject_id string, metric_key string, day date, value double")).count() == 0
    fewer = periodicity.weekly(rhythm(spark, 1, 60, 1.0, 0.1), Thresholds(null_samples=50)).first()
    assert fewer["null_sd"] > 0
