"""Registered queries: each operator on the given tables, with columns named and rounded for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import dates, stats, text
from tideline.operators import association, multiplicity, resample, series, windows
from tideline.operators import residuals as least_squares
from tideline.operators.residuals import adjusted
from tideline.plans import diary, engine, scans
from tideline.schema import THRESHOLDS
from tideline.sources import export, store, tables
from tideline.sources.tables import read

#: Replicates of the registered bootstraps of single operators.
REPS = THRESHOLDS.replicates


def _r(c: Column | str, name: str | None = None) -> Column:
    own = F.col(c) if isinstance(c, str) else c
    return F.round(own, 6).alias(name or c)  # type: ignore[arg-type]


def _split(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    return s.filter(F.col("metric_key").isin("purchase", "view")), s.filter(F.col("metric_key").isin("click", "error", "signup"))


def _events(spark: SparkSession, d: str, by_user: bool = False) -> DataFrame:
    return tables.event_series(read(spark, d, "events"), by_user)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.col("o_orderpriority").alias("metric_key"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("value"))
    return series.daily_mean(rows, ["metric_key"], "day", F.col("value"))


def _diary(spark: SparkSession, d: str) -> DataFrame:
    return tables.diary(read(spark, d, "orders"), read(spark, d, "lineitem"))


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, predictors, tags) of the orders' diaries; the number of unlocks and screen time stay out of the tests."""
    return tables.demo_series(_diary(spark, d).drop("unlock_count", "screen_minutes"))


def daily_mean(s, d):
    return _events(s, d).select("subject_id", "metric_key", "day", _r("value"))


def tag_days(s, d):
    e = read(s, d, "events").select("user_id", F.col("event_type").alias("tag"), F.col("ts").cast("date").alias("day"))
    return series.tag_days(e, ["user_id"])


def day_boundary(s, d):
    c = tables.check_ins(read(s, d, "events"))
    return c.select("id", dates.local_day(F.col("ts"), F.col("zone_id")).alias("day"), dates.sleep_day(F.col("ts"), F.col("zone_id")).alias("sleep_day"))


def unpivot_metrics(s, d):
    return series.unpivot_metrics(_diary(s, d), ["subject_id"]).select("subject_id", "metric_key", "day", _r("value"))


def demo_seed(s, d):
    """A demonstration history for every user of the events."""
    users = read(s, d, "events").select(F.col("user_id").cast("string").alias("subject_id")).distinct()
    return tables.demo(s, users).select("subject_id", "i", "day", "mood", "energy", F.concat_ws(";", "tags").alias("tags"), _r("sleep_minutes"), "unlock_count", _r("exercise_minutes"))


def lag_align(s, d):
    return series.lag_align(*_split(_events(s, d))).select("outcome", "predictor", "lag", "day", _r("y"), _r("x"), "weekend")


def weekend_flag(s, d):
    days = read(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", dates.is_weekend(F.col("day")).alias("weekend"), dates.day_name(F.col("day")).alias("name"), F.unix_date("day").alias("epoch_day"))


def avg_rank(s, d):
    e = read(s, d, "events").select("event_id", "event_type", F.floor("value").alias("v"))
    return e.withColumn("rnk", windows.average_rank("v", ["event_type"])).select("event_id", "rnk")


def _by_pair(s, d):
    return series.lag_align(*_split(_events(s, d))).select("outcome", "predictor", "lag", "day", F.round("y", 9).alias("y"), F.round("x", 9).alias("x"))


def pearson(s, d):
    return _by_pair(s, d).groupBy("outcome", "predictor", "lag").agg(F.count(F.lit(1)).alias("n"), _r(stats.pearson(F.col("x"), F.col("y")), "r"))


def spearman(s, d):
    return association.spearman(_by_pair(s, d), ["outcome", "predictor", "lag"], "x", "y").select("outcome", "predictor", "lag", "n", _r("effect"))


def group_stats(s, d):
    e = read(s, d, "events")
    inside = F.col("user_id") % 2 == 1
    v = F.col("value")
    return e.groupBy("event_type").agg(_r(F.percentile("value", 0.5), "median"), _r(stats.sample_sd(v), "sd"), _r(stats.mean_difference(v, inside), "difference"), _r(stats.standardised_difference(v, inside), "d"), F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"))


def centred_mean(s, d):
    return _orders(s, d).select("metric_key", "day", _r(windows.centred_mean("value", ["metric_key"], 29), "trend"))


def trailing_mean(s, d):
    return windows.trailing_mean(_orders(s, d), ["metric_key"]).select("metric_key", "day", _r("mean"))


def _nights(s, d):
    return _diary(s, d).select("subject_id", "day", F.col("sleep_minutes").alias("value")).filter("value IS NOT NULL")


def sleep_baseline(s, d):
    return windows.sleep_baseline(_nights(s, d), ["subject_id"]).select("subject_id", "day", _r("baseline"))


def sleep_debt(s, d):
    return windows.sleep_debt(_nights(s, d), ["subject_id"]).select("subject_id", "day", _r("debt"))


def line_segments(s, d):
    days = read(s, d, "events").select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    return windows.line_segments(days, ["user_id"]).select("user_id", "day", F.col("segment_id").cast("int").alias("segment_id"))


def chart_coordinates(s, d):
    w = Window.partitionBy("metric_key")
    o = _orders(s, d).withColumns({"low": F.min("value").over(w), "high": F.max("value").over(w)})
    last = F.lit("1998-12-31").cast("date")
    first = F.date_sub(last, 89)
    o = o.filter(F.col("day").between(first, last))
    return o.select("metric_key", "day", _r(dates.chart_x(F.col("day"), first, last), "cx"), _r(dates.chart_y(F.col("value"), F.col("low"), F.col("high")), "cy"))


def residuals(s, d):
    rows = association.correlation_rows(*_split(_events(s, d)))
    return rows.select("outcome", "predictor", "lag", "day", _r("rx"), _r("ry"))


def residuals_of_many(s, d):
    rows = series.lag_align(*_split(_events(s, d)), THRESHOLDS.max_lag).withColumn("age", F.datediff("day", F.lit("2020-01-01")))
    rows = least_squares.residuals_of_many(rows, "y", ["weekend", "x", "age"], association.PAIR, "res")
    return rows.select("outcome", "predictor", "lag", "day", _r("res"))


def circular_shift(s, d):
    packed = resample.gathered(_diary(s, d), ["subject_id"], ["mood"])
    values = F.transform("rows", lambda r: r["mood"])
    return packed.select("subject_id", F.posexplode(resample.circular_shift(values, F.lit(-3))).alias("pos", "mood"))


def _energy(s, d):
    return _diary(s, d).select("subject_id", F.concat(F.lit("t:"), F.col("subject_id")).alias("test_id"), "day", F.col("energy").cast("double").alias("ry"))


def block_permute(s, d):
    """Of each draw, the sum of the values by their places, which tells orders apart."""
    keys = ["subject_id", "test_id"]
    out = resample.block_permuted(resample.gathered(_energy(s, d), keys, ["ry"]), keys, THRESHOLDS.null_samples, THRESHOLDS.seed)
    weighed = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return out.select("subject_id", "draw", weighed.alias("weighed"))


def _boot(s, d):
    rows = _diary(s, d).filter("sleep_minutes IS NOT NULL").select("subject_id", F.concat(F.lit("t:"), F.col("subject_id")).alias("test_id"), "day", "sleep_minutes", F.col("energy").cast("double").alias("energy"))
    keys = ["subject_id", "test_id"]
    drawn = resample.block_bootstrap(resample.gathered(rows, keys, ["sleep_minutes", "energy"]), keys, "sleep_minutes", "energy", REPS, THRESHOLDS.seed)
    return drawn.groupBy("subject_id", "rep").agg(stats.pearson(F.col("a"), F.col("b")).alias("r"))


def block_bootstrap(s, d):
    return _boot(s, d).select("subject_id", "rep", _r("r"))


def quantile_ci(s, d):
    q = F.percentile("r", F.array(F.lit(0.025), F.lit(0.975)))
    return _boot(s, d).groupBy("subject_id").agg(q.alias("q")).select("subject_id", _r(F.get("q", 0), "low"), _r(F.get("q", 1), "high"))


def se_interval(s, d):
    z = stats.fisher_z(F.col("r"))
    out = _boot(s, d).groupBy("subject_id").agg(F.avg("r").alias("m"), F.stddev_samp(z).alias("se"))
    side = lambda k: stats.inverse_fisher_z(stats.fisher_z(F.col("m")) + k * engine.Z_DISPLAY * F.col("se"))
    return out.select("subject_id", _r(side(-1), "low"), _r(side(1), "high"), _r(stats.bootstrap_p(stats.fisher_z(F.col("m")), F.col("se")), "p"))


def rotation_null(s, d):
    tests, _ = engine.correlation_tests(*_split(_events(s, d)))
    return tests.select("test_id", "n", _r("effect"), _r("null_sd"), "null_method")


def rotation_null_by_user(s, d):
    e = read(s, d, "events").groupBy(F.col("user_id").cast("string").alias("subject_id"), F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).cast("double").alias("n"))
    side = lambda key, c: e.select("subject_id", F.lit(key).alias("metric_key"), "day", F.col(c).alias("value"))
    tests, _ = engine.correlation_tests(side("mean", "mean"), side("count", "n"))
    return tests.select("subject_id", "test_id", "n", _r("effect"), _r("null_sd"))


def block_null(s, d):
    o, _, _ = _inputs(s, d)
    tests, _ = engine.group_tests(association.weekday_rows(o), "DAY_OF_WEEK")
    return tests.select("subject_id", "test_id", "n", _r("effect"), _r("null_sd"))


def normal_curve(s, d):
    e = read(s, d, "events").select("event_id", ((F.col("value") - 50) / 25).alias("z"))
    return e.select("event_id", _r(stats.normal_cdf(F.col("z")), "cdf"), _r(stats.normal_quantile((F.col("event_id") % 997 + 1) / 998), "quantile"), _r(stats.t_survival(F.col("z")), "t_sf"), _r(stats.fisher_z(F.col("z") / 4), "fz"), stats.block_length(F.col("event_id") % 500 + 4).alias("block"), stats.rotation_margin(F.col("event_id") % 500).alias("margin"))


def student_t(s, d):
    e = read(s, d, "events").select("event_id", ((F.col("value") - 50) / 25).alias("t"), (F.col("event_id") % 40 + 1).cast("double").alias("df"), ((F.col("event_id") % 97 + 1) / 7).alias("x"))
    return e.select("event_id", _r(stats.t_survival_of(F.col("t"), F.col("df")), "t_sf"), _r(stats.ln_gamma(F.col("x")), "ln_gamma"))


def _corr(s, d):
    return engine.scored(engine.correlation_tests(*_split(_events(s, d)))[0])


def corr_tests(s, d):
    return _corr(s, d).select("test_id", "kind", "n", _r("effect"), _r("p"), "strength", "confidence")


def bh_threshold(s, d):
    e = read(s, d, "events").select("user_id", "event_id", ((F.col("event_id") * 7919) % 1000 / 1000.0).alias("u"))
    tests = e.withColumn("p", F.col("u") * F.col("u") * F.col("u"))
    out = multiplicity.tiers(multiplicity.bh_threshold(tests, ["user_id"]))
    return out.select("event_id", F.col("family").cast("int").alias("family"), _r("bh"), "confidence")


def _group(s, d, kind):
    o, _, t = _inputs(s, d)
    rows = association.tag_rows(o, t) if kind == "TAG" else association.weekday_rows(o)
    return engine.scored(engine.group_tests(rows, kind)[0])


def tag_tests(s, d):
    return _group(s, d, "TAG").select("subject_id", "test_id", "n", _r("effect"), _r("raw_difference"), _r("p"), "confidence")


def dow_tests(s, d):
    return _group(s, d, "DAY_OF_WEEK").select("subject_id", "test_id", "n", _r("effect"), _r("raw_difference"), _r("p"), "confidence")


def reverse_check(s, d):
    o, p, _ = _inputs(s, d)
    return association.reverse_checks(o, p).select("subject_id", "outcome", "predictor", "lag", _r("reverse"))


def strength_bands(s, d):
    e = (F.col("l_discount") * 10 - 0.5).alias("effect")
    rows = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(e, 6).alias("effect"))
    c = F.when(F.col("l_linenumber") % 2 == 0, "CLEAR").otherwise("TENTATIVE")
    return rows.select("l_orderkey", "l_linenumber", text.strength(F.col("effect")).alias("strength"), text.direction(F.col("effect")).alias("direction"), _r(text.rank_score(F.col("effect"), c), "score"), text.lag_phrase(F.col("l_linenumber")).alias("phrase"))


def dedupe_rank(s, d):
    rows = read(s, d, "lineitem").select(F.concat(F.lit("corr:"), F.col("l_orderkey").cast("string"), F.lit(":lag"), F.col("l_linenumber").cast("string")).alias("test_id"), F.col("l_discount").alias("score"), F.col("l_linenumber").alias("ordinal"))
    return multiplicity.strongest(rows.withColumn("pair", text.pair_of(F.col("test_id"))), [], "pair", "score", "ordinal").select("pair", "test_id")


def pending(s, d):
    o, p = _split(_events(s, d, True))
    return engine.pending(o, p).select("subject_id", "id", "label", "days_available", "days_required", "days_remaining", _r(text.progress(F.col("days_available"), F.col("days_required")), "progress"))


def report(s, d):
    out = engine.analyse(*_inputs(s, d), tables.metric_labels(s)).insights
    return out.select("subject_id", "place", "test_id", "kind", "headline", "detail", _r("effect"), _r("ci_low"), _r("ci_high"), "n", "confidence", "strength", F.concat_ws(" / ", "caveats").alias("caveats"))


def report_tests(s, d):
    out = engine.analyse(*_inputs(s, d), tables.metric_labels(s)).tests
    return out.select("subject_id", "test_id", "kind", "n", _r("effect"), _r("null_sd"), _r("p"), F.col("family").cast("int").alias("family"), "confidence")


def report_summary(s, d):
    return engine.summary(engine.analyse(*_inputs(s, d), tables.metric_labels(s)))


def next_reminder(s, d):
    """Minutes from each check-in to nine in the evening of its zone."""
    c = tables.check_ins(read(s, d, "events"))
    return c.select("id", _r(dates.until_next(F.col("ts"), F.col("zone_id"), 21) / 60_000_000, "minutes"))


def _tagged(s, d):
    c = store.stamped(tables.check_ins(read(s, d, "events")))
    tags = c.select(F.col("id").alias("check_in_id"), "tag").union(c.select(F.col("id").alias("check_in_id"), F.lit("a,b")).filter("check_in_id % 5 = 0"))
    return c.drop("tag"), tags


def csv_export(s, d):
    c, tags = _tagged(s, d)
    return export.csv_lines(store.with_tags(c, tags), ["id"]).select("id", "line")


def json_export(s, d):
    c, tags = _tagged(s, d)
    return export.check_in_json(store.with_tags(c, tags))


def upsert_latest(s, d):
    e = read(s, d, "events").select("user_id", "event_type", "event_id", "value")
    return store.upsert_latest(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


def save_check_ins(s, d):
    c, _ = _tagged(s, d)
    c = c.select("id", "ts", "zone_id", "day", "mood", "energy", "note")
    changes = c.filter("id % 3 = 0").withColumns({"mood": F.lit(3), "note": F.lit("  ")})
    return store.save_check_ins(c.filter("id % 2 = 0"), changes).select("id", "day", "mood", "energy", "note")


def cascade_delete(s, d):
    c, tags = _tagged(s, d)
    kept, left = store.delete_check_ins(c, tags, c.filter("mood < 0").select("id"))
    return kept.select("id", F.lit("check_in").alias("what")).union(left.select("check_in_id", "tag"))


def replace_tags(s, d):
    _, tags = _tagged(s, d)
    touched = tags.filter("check_in_id % 4 = 1").select(F.col("check_in_id").alias("id")).distinct()
    return store.replace_tags(tags, touched.select(F.col("id").alias("check_in_id"), F.lit("new").alias("tag")), touched).select("check_in_id", "tag")


def add_tags(s, d):
    names = read(s, d, "part").select(F.concat(F.lit(" \t"), F.col("p_brand"), F.lit(" ")).alias("name"))
    return store.add_tags(tables.default_tags(s), names)


def day_count(s, d):
    e = read(s, d, "events")
    return e.agg(F.countDistinct(F.col("ts").cast("date")).alias("days"), F.count(F.lit(1)).alias("rows"), (F.datediff(F.max(F.col("ts").cast("date")), F.min(F.col("ts").cast("date"))) + 1).cast("int").alias("span"))


def scale_labels(s, d):
    c = tables.check_ins(read(s, d, "events"))
    return c.select("id", "mood", text.mood_label(F.col("mood")).alias("mood_label"), text.energy_label(F.col("energy")).alias("energy_label"), text.signed(F.col("mood")).alias("signed"))


def format_minutes(s, d):
    return read(s, d, "events").select("event_id", text.format_minutes(F.col("value") * 7).alias("minutes"))


def scan_since(s, d):
    c, tags = _tagged(s, d)
    return store.with_tags(c.filter(F.col("day") >= F.lit("2024-01-20").cast("date")), tags).select("id", "day", F.concat_ws(";", "tags").alias("tags"))


def last_value(s, d):
    e = read(s, d, "events").select("user_id", F.col("ts").cast("date").alias("day"), "value", "event_id")
    return series.last_wins(e, ["user_id"], "day", "value", "event_id").select("user_id", "day", _r("value"))


NAMES = (
    daily_mean, tag_days, day_boundary, unpivot_metrics, demo_seed, lag_align, weekend_flag, avg_rank, pearson, spearman, group_stats, centred_mean, trailing_mean, sleep_baseline, sleep_debt, line_segments,
    chart_coordinates, residuals, residuals_of_many, circular_shift, block_permute, block_bootstrap, quantile_ci, se_interval, rotation_null, rotation_null_by_user, block_null, normal_curve, student_t, corr_tests, bh_threshold, tag_tests,
    dow_tests, reverse_check, strength_bands, dedupe_rank, pending, report, report_tests, report_summary, next_reminder, csv_export, json_export, upsert_latest, save_check_ins, cascade_delete, replace_tags, add_tags, day_count, scale_labels,
    format_minutes, scan_since, last_value,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*NAMES, *diary.NAMES, *scans.NAMES)}
