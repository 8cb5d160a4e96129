"""Known values of the scalar functions and windows."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import dates, stats, text
from tideline.operators import association, multiplicity, resample, windows
from tideline.operators.residuals import adjusted, residuals_of_many
from tideline.sources import store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def series(spark, rows, names="k string, day date, value double"):
    start = datetime.date(2026, 1, 5)
    return spark.createDataFrame([("a", start + datetime.timedelta(d), *map(float, v)) for d, *v in rows], names)


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", v) for v in (10.0, 20.0, 20.0, 30.0)], "k string, v double")
    assert sorted(r["r"] for r in df.select(windows.average_rank("v", ["k"]).alias("r")).collect()) == [1, 2.5, 2.5, 4]


def test_spearman_of_a_monotone_relation_is_one(spark):
    df = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(20)], "k string, x double, y double")
    assert association.spearman(df, ["k"], "x", "y").first()["effect"] == pytest.approx(1)
    assert df.agg(stats.pearson(F.col("x"), F.col("y"))).first()[0] < 0.98


def test_no_variance_has_no_correlation(spark):
    df = spark.createDataFrame([("a", 3.0, float(i)) for i in range(10)], "k string, x double, y double")
    assert association.spearman(df, ["k"], "x", "y").first()["effect"] is None


def test_adjusting_removes_a_confounder(spark):
    r = random.Random(1)
    rows = [(i, 5.0 * (i % 7 >= 5) + r.gauss(0, 1), 5.0 * (i % 7 >= 5) + r.gauss(0, 1)) for i in range(200)]
    df = series(spark, rows, "k string, day date, x double, y double").withColumn("weekend", dates.is_weekend(F.col("day")).cast("int"))
    assert abs(association.spearman(df, ["k"], "x", "y").first()["effect"]) > 0.5
    df = adjusted(adjusted(df, ["k"], "x", "rx"), ["k"], "y", "ry")
    assert abs(association.spearman(df, ["k"]).first()["effect"]) < 0.2


def test_residuals_of_many_equal_least_squares(spark):
    r = random.Random(4)
    rows = [("wide", i, *(r.gauss(0, 1) for _ in range(3)), 1000.0 + i, r.gauss(5, 2)) for i in range(40)]
    rows += [("flat", i, r.gauss(0, 1), 7.0, r.gauss(0, 1), float(i), r.gauss(0, 1)) for i in range(9)]  # one covariate without variance
    rows += [("tied", i, float(i), 2.0 * i + 1, r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1)) for i in range(9)]  # two that determine each other
    rows += [("few", i, *(r.gauss(0, 1) for _ in range(4)), r.gauss(0, 1)) for i in range(5)]  # as many rows as coefficients
    rows += [("one", 0, 1.0, 2.0, 3.0, 4.0, 5.0)]
    holes = [("wide", 100, None, 1.0, 1.0, 1.0, 9.0), ("wide", 101, 1.0, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows + holes, "k string, i int, a double, b double, c double, d double, y double")
    out = residuals_of_many(df, "y", ["a", "b", "c", "d"], ["k"], "res")
    assert out.columns == [*df.columns, "res"]
    got = {(x["k"], x["i"]): x["res"] for x in out.collect()}
    assert got.pop(("wide", 100)) is None
    assert got.pop(("wide", 101)) is None
    for key in ("wide", "flat", "tied", "few", "one"):
        part = [x for x in rows if x[0] == key]
        y = np.array([x[6] for x in part])
        design = np.column_stack([np.ones(len(part)), np.array([x[2:6] for x in part])])
        expected = y - design @ np.linalg.lstsq(design, y, rcond=None)[0] if key in ("wide", "flat") else y
        assert [got[key, x[1]] for x in part] == pytest.approx(expected.tolist(), abs=1e-9)
    exchanges = residuals_of_many(df, "y", ["a", "b", "c", "d"], ["k"], "res")._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges == 1  # before it runs, the plan is printed once: every step shares one shuffle
    assert residuals_of_many(df.limit(0), "y", ["a"], ["k"], "res").count() == 0


@pytest.mark.parametrize(("t", "p"), [(1.697, 0.05), (2.042, 0.025), (2.750, 0.005), (3.646, 0.0005), (0.0, 0.5)])
def test_t_table(spark, t, p):
    assert one(spark, stats.t_survival(F.lit(t))) == pytest.approx(p, rel=0.01)


@pytest.mark.parametrize(("p", "z"), [(0.975, 1.959964), (0.995, 2.575829), (0.5, 0.0)])
def test_normal_quantile(spark, p, z):
    assert one(spark, stats.normal_quantile(F.lit(p))) == pytest.approx(z, abs=1e-6)
    assert one(spark, stats.normal_cdf(F.lit(z))) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize(("ps", "bh"), [([0.001, 0.008, 0.04, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95], 0.008), ([0.4, 0.6, 0.9], None)])
def test_step_up_threshold(spark, ps, bh):
    df = spark.createDataFrame([("s", p) for p in ps], "k string, p double")
    assert multiplicity.bh_threshold(df, ["k"]).first()["bh"] == bh


@pytest.mark.parametrize(("offset", "first"), [(1, 2), (3, 4), (4, 1), (-1, 4)])
def test_rotation(spark, offset, first):
    assert one(spark, resample.circular_shift(F.array(*map(F.lit, (1, 2, 3, 4))), F.lit(offset)))[0] == first


def test_blocks_grow_with_history(spark):
    assert one(spark, stats.block_length(F.lit(500))) > one(spark, stats.block_length(F.lit(30)))


def test_days_change_at_four_and_hours_go_off_the_instant(spark):
    at = F.lit("2026-03-08T08:30:00Z").cast("timestamp")
    assert one(spark, dates.local_day(at, F.lit("America/New_York"))) == datetime.date(2026, 3, 7)


def test_sleep_debt(spark):
    nights = {d: 420 for d in range(40)} | {37: 300, 38: 360, 39: 420}
    debt = {r["day"]: r["debt"] for r in windows.sleep_debt(series(spark, nights.items()), ["k"]).collect()}
    start = datetime.date(2026, 1, 5)
    assert debt[start + datetime.timedelta(39)] == 180 and debt[start + datetime.timedelta(20)] == 0
    del nights[38]
    debt = {r["day"] for r in windows.sleep_debt(series(spark, nights.items()), ["k"]).collect()}
    assert start + datetime.timedelta(39) not in debt


def test_block_permutation_keeps_the_values(spark):
    df = spark.createDataFrame([("a", "t", d, float(d)) for d in range(30)], "k string, test_id string, day int, ry double")
    out = resample.block_permuted(resample.gathered(df, ["k", "test_id"], ["ry"]), ["k", "test_id"], 3, 1).collect()
    assert len(out) == 3 and all(sorted(r["values"]) == [float(d) for d in range(30)] for r in out)
    assert len({tuple(r["values"]) for r in out}) > 1


def test_bootstrap_interval_has_width(spark):
    r = random.Random(2)
    x = y = 0.0
    rows = []
    for d in range(120):
        x, y = x + r.gauss(0, 1), y + r.gauss(0, 1)
        rows.append(("a", "t", d, x, y))
    df = spark.createDataFrame(rows, "k string, test_id string, day int, x double, y double")
    drawn = resample.block_bootstrap(resample.gathered(df, ["k", "test_id"], ["x", "y"]), ["k", "test_id"], "x", "y", 100, 5)
    got = [v["r"] for v in drawn.groupBy("rep").agg(stats.pearson(F.col("a"), F.col("b")).alias("r")).collect()]
    assert len(got) == 100 and max(got) - min(got) > 0.1


@pytest.mark.parametrize(("value", "cell"), [("a", "a"), ("a,b", '"a,b"'), ('a"b', '"a""b"'), ("a\nb", '"a\nb"'), ("a\rb", "a\rb")])
def test_csv_cells(spark, value, cell):
    assert one(spark, text.csv_cell(F.lit(value))) == cell


def test_texts(spark):
    assert one(spark, text.pair_of(F.lit("corr:mood:sleep:lag2"))) == "corr:mood:sleep"
    assert one(spark, text.format_minutes(F.lit(425.9))) == "7h 5m" and one(spark, text.format_minutes(F.lit(45.0))) == "45m"
    assert one(spark, text.clamp_scale(F.lit(-2.5))) == -2 and one(spark, text.clamp_scale(F.lit(9.0))) == 3
    assert one(spark, text.mood_label(F.lit(3))) == "Very good" and one(spark, text.energy_label(F.lit(-3))) == "Drained"
    assert one(spark, text.clean_tag(F.lit("\t Late Night "))) == "late night"
    assert math.isclose(one(spark, stats.inverse_fisher_z(stats.fisher_z(F.lit(0.5)))), 0.5)


def test_beta_gamma_and_student(spark):
    f = stats.incomplete_beta
    row = spark.range(1).select(
        stats.ln_gamma(F.lit(5.0)).alias("g"), stats.ln_gamma(F.lit(0.5)).alias("h"), stats.ln_gamma(F.lit(0.0)).alias("none"),
        f(F.lit(0.5), F.lit(2.0), F.lit(3.0)).alias("b"), f(F.lit(0.9), F.lit(2.0), F.lit(3.0)).alias("c"), f(F.lit(0.0), F.lit(1.0), F.lit(2.0)).alias("zero"),
        *[stats.t_survival(F.lit(1.3), df).alias(f"t{df}") for df in (1, 2, 3, 7, 30)], *[stats.t_survival_of(F.lit(1.3), F.lit(float(df))).alias(f"u{df}") for df in (1, 2, 3, 7, 30)],
    ).first()
    assert row["g"] == pytest.approx(math.log(24)) and row["h"] == pytest.approx(math.log(math.pi) / 2) and row["none"] is None
    assert row["b"] == pytest.approx(0.6875) and row["c"] == pytest.approx(0.9963) and row["zero"] == 0
    assert row["t1"] == pytest.approx(0.5 - math.atan(1.3) / math.pi) and row["t2"] == pytest.approx(0.5 - 1.3 / (2 * math.sqrt(2 + 1.69)))
    assert all(row[f"t{df}"] == pytest.approx(row[f"u{df}"], abs=1e-10) for df in (1, 2, 3, 7, 30))


def test_named_scans_and_preferences(spark):
    tags = spark.createDataFrame([("b", 2, True), ("a", 2, True), ("c", 1, False)], "name string, sort_order int, enabled boolean")
    assert [r["name"] for r in store.tags_in_order(tags).collect()] == ["c", "a", "b"] and [r["name"] for r in store.enabled_tags(tags).collect()] == ["a", "b"]
    assert store.count_tags(tags).first()["n"] == 3
    assert sorted(r["name"] for r in store.delete_tags(tags, tags.filter("name = 'a'")).collect()) == ["b", "c"]
    changed = store.upsert_tags(tags, spark.createDataFrame([("a", 9, False), ("d", 3, True)], tags.schema))
    assert sorted(tuple(r) for r in changed.collect()) == [("a", 9, False), ("b", 2, True), ("c", 1, False), ("d", 3, True)]
    rows = spark.sql("SELECT id, timestamp_seconds(id * 50000) AS ts, date_add(DATE'1970-01-01', CAST(id * 50000 DIV 86400 AS INT)) AS day FROM range(6)")
    assert [r["id"] for r in store.newest_first(rows).collect()] == [5, 4, 3, 2, 1, 0] and [r["id"] for r in store.newest_first(rows, "1970-01-01").collect()] == [1, 0]
    assert [r["id"] for r in store.oldest_first(rows, "1970-01-02").collect()] == [2, 3, 4, 5]
    assert store.days_in_order(rows, "1999-01-01").count() == 0 and store.days_in_order(rows, "1970-01-01").count() == 1 and store.first_of(rows, "id", 3, ["ts"]).first()["id"] == 3
    assert store.charted(spark.createDataFrame([("mood",), ("sleep_debt_3d",)], "metric_key string")).count() == 1
    stored = spark.createDataFrame([("reminder_hour", "7"), ("reminder_enabled", "false"), ("other", "x")], "key string, value string")
    own = store.preferences(stored).first()
    assert (own["reminder_hour"], own["reminder_enabled"], own["midday_reminder_hour"]) == (7, False, 13)
    assert store.preferences(stored.limit(0)).first()["reminder_hour"] == 21


def test_time_until_the_next_hour(spark):
    rows = [("2024-01-01T20:59:30", "UTC", 0.5), ("2024-01-01T21:00:00", "UTC", 1440.0), ("2024-01-01T21:00:01", "UTC", 1439 + 59 / 60), ("2024-01-01T05:00:00", "America/New_York", 1260.0), ("2024-03-10T05:30:00", "America/New_York", 1230.0)]
    df = spark.createDataFrame([(t, z) for t, z, _ in rows], "t string, z string").select(F.col("t").cast("timestamp").alias("t"), "z")
    got = [r["m"] for r in df.select((dates.until_next(F.col("t"), F.col("z"), 21) / 60_000_000).alias("m")).collect()]
    assert got == pytest.approx([m for _, _, m in rows])  # the last on a day whose clocks go forward: by the wall clock
    assert one(spark, dates.until_next(F.lit("2024-01-01T12:00:00").cast("timestamp"), F.lit("UTC"), F.lit(12), F.lit(15))) == 15 * 60_000_000
