"""The analysis: candidates, nulls, p-values, correction, findings.

Everything is keyed by subject and test; nothing is collected on the driver.
A test's days are gathered once and persisted, since effects, nulls and
intervals all read them.
Each family is one subject's candidates. Intervals come from a bootstrap that
runs for surviving tests only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tideline.functions.stats import fisher_z, inverse_fisher_z, p_against_null
from tideline.functions.text import CONFIDENCE, NOTHING, confidence_label, direction, lag_phrase, pair_of, rank_score, sentence, strength, two_places
from tideline.operators.association import GROUP, PAIR, correlation_kind, gathered_groups, gathered_pairs, reverse_checks, tag_rows, weekday_rows
from tideline.operators.multiplicity import bh_threshold, strongest, tiers
from tideline.operators.nulls import MEASURES, Measures, bootstrap_error, examined
from tideline.schema import THRESHOLDS, WEEKDAYS, Thresholds

#: 97.5 % point of the normal distribution, for intervals at the display level.
Z_DISPLAY = 1.959963984540054
COMMON = ["subject_id", "test_id", "kind", "outcome", "predictor", "lag", "grp", "n", "effect", "scaled", "raw_difference", "null_sd", "null_method"]


@dataclass
class Report:
    """``tests``: every candidate with p and tier; ``insights``: ranked findings; ``pending``: gates not reached yet.

    The first two read persisted tables; ``release`` frees them, after which both are computed anew where read again.
    """

    tests: DataFrame
    insights: DataFrame
    pending: DataFrame
    persisted: tuple[DataFrame, ...] = ()
    #: The input series, persisted too, since every kind of test reads them.
    inputs: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for df in (*self.persisted, *self.inputs):
            df.unpersist()


def correlation_tests(outcomes: DataFrame, predictors: DataFrame, t: Thresholds = THRESHOLDS, m: Measures = MEASURES) -> tuple[DataFrame, DataFrame]:
    """(candidates, gathered days) of the lagged rank correlations, or of the measures' own statistic; ``scaled`` is the effect on the null's scale."""
    packed = gathered_pairs(outcomes, predictors, t).persist(StorageLevel.MEMORY_AND_DISK)
    tests = examined(packed, [*PAIR, "test_id"], False, t, m).withColumn("kind", correlation_kind(F.col("predictor"), F.col("lag")))
    return tests.withColumn("grp", F.lit(None).cast("string")).select(*COMMON), packed


def group_tests(rows: DataFrame, kind: str, t: Thresholds = THRESHOLDS, m: Measures = MEASURES) -> tuple[DataFrame, DataFrame]:
    """(candidates, gathered days) of group comparisons."""
    packed = gathered_groups(rows, t.min_days_tag if kind == "TAG" else t.min_days_dow, t).persist(StorageLevel.MEMORY_AND_DISK)
    tests = examined(packed, [*GROUP, "test_id"], True, t, m)
    return tests.withColumns({"kind": F.lit(kind), "predictor": F.lit(None).cast("string"), "lag": F.lit(None).cast("int")}).select(*COMMON), packed


def scored(candidates: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """p, family, threshold, confidence and strength of candidates that have an effect and a null."""
    tests = candidates.filter("effect IS NOT NULL AND null_sd IS NOT NULL").withColumn("p", p_against_null(F.col("scaled"), F.col("null_sd")))
    return tiers(bh_threshold(tests, ["subject_id"], "p", t.fdr_q), "p", t.familywise_alpha).withColumn("strength", strength(F.col("effect")))


def intervals(survivors: DataFrame, correlations: DataFrame, groups: DataFrame, t: Thresholds = THRESHOLDS, m: Measures = MEASURES) -> DataFrame:
    """(subject_id, test_id, ci_low, ci_high) of surviving tests, by the bootstrap's standard error on the effect's scale and back."""
    keep = survivors.select("subject_id", "test_id")
    keys = ["subject_id", "test_id"]
    own = bootstrap_error(correlations.join(keep, keys, "left_semi"), keys, False, t, m.correlation, m.transform, m.draw)
    stats = own.unionByName(bootstrap_error(groups.join(keep, keys, "left_semi"), keys, True, t, m.difference, None, m.draw))
    found = survivors.join(stats, keys)
    correlation = F.col("grp").isNull()
    back = inverse_fisher_z if m.inverse == MEASURES.inverse else F.pandas_udf(lambda v: pd.Series(m.inverse(v.to_numpy())), "double")
    side = {name: F.col("scaled") + sign * Z_DISPLAY * F.col("se") for name, sign in (("ci_low", -1), ("ci_high", 1))}
    return found.select(*keys, *[F.when(correlation, back(v)).otherwise(v).alias(k) for k, v in side.items()])


def pending(outcomes: DataFrame, predictors: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """Analyses that wait for more days, per subject."""
    days = outcomes.groupBy("subject_id", "metric_key").count().groupBy("subject_id").agg(F.max("count").cast("int").alias("days"))
    sleep = predictors.groupBy("subject_id").agg(F.max(F.col("metric_key").startswith("sleep")).alias("sleep"))
    gates = ((1, "same_day", "Same-day patterns", t.min_days_same_day), (2, "lagged", "Effects of previous days", t.min_days_lagged), (3, "day_of_week", "Day-of-week pattern", t.min_days_dow))
    rows = [F.when(F.col("days") < need, F.struct(F.lit(k).alias("place"), F.lit(i).alias("id"), F.lit(label).alias("label"), F.col("days").alias("days_available"), F.lit(need).alias("days_required"))) for k, i, label, need in gates]
    rows.append(F.when(~F.coalesce("sleep", F.lit(False)), F.struct(F.lit(4).alias("place"), F.lit("sleep").alias("id"), F.lit("Sleep effects").alias("label"), F.lit(0).alias("days_available"), F.lit(t.min_days_sleep_debt).alias("days_required"))))
    found = days.join(sleep, "subject_id", "full").withColumn("days", F.coalesce("days", F.lit(0))).select("subject_id", F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))
    return found.withColumn("days_remaining", F.greatest(F.lit(0), F.col("days_required") - F.col("days_available")))


# What findings say.
TEXTS = {
    "SAME_DAY": "Higher {p_lower} goes with {dir} {o_lower} the same day",
    "LAGGED": "{p} {lag} tracks {dir} {o_lower}",
    "SLEEP_DEBT": "Accumulated sleep debt tracks {dir} {o_lower}",
    "TAG": '{o} runs {dir} on days tagged "{grp}"',
    "DAY_OF_WEEK": "{o} tends to be {dir} on {grp}s",
    "association": " association (rho = {effect}",
    "difference": " difference (d = {effect}",
    "points": ", about {raw} points on the scale",
    "interval": ", 95% CI {low} to {high}, over {n} days). Adjusted for weekday/weekend and slow drift. This is an association in your own data, not evidence of cause.",
    "tentative": "Survives the false-discovery check but not the strictest one, so treat it as a lead rather than a settled finding.",
    "short": "Based on a short history ({n} days); expect this to move.",
    "both_ways": "The reverse also holds about as strongly ({o} predicts later {p} at {reverse}), so which way this runs is unclear.",
}


def worded(found: DataFrame) -> DataFrame:
    """Adds headline, detail and caveats to what ``_labelled`` gives."""
    columns = {"o": F.col("o_name"), "p": F.col("p_name"), "p_lower": F.lower("p_name"), "o_lower": F.lower("o_name"), "dir": direction(F.col("effect")), "grp": F.col("grp"), "lag": lag_phrase(F.col("lag")), "effect": two_places(F.col("effect"))}
    columns |= {"raw": two_places(F.abs("raw_difference")), "low": two_places(F.col("ci_low")), "high": two_places(F.col("ci_high")), "n": F.col("n").cast("string"), "reverse": two_places(F.col("reverse"))}

    def say(name: str) -> Column:
        """A text with its columns put in."""
        return F.concat(*[columns[part] if k % 2 else F.lit(part) for k, part in enumerate(re.split(r"\{(\w+)\}", TEXTS[name])) if part])

    kind = F.col("kind")
    head = F.when(kind == "SAME_DAY", say("SAME_DAY")).when(kind == "LAGGED", say("LAGGED")).when(kind == "SLEEP_DEBT", say("SLEEP_DEBT")).when(kind == "TAG", say("TAG")).otherwise(say("DAY_OF_WEEK"))
    what = F.when(F.col("grp").isNull(), say("association")).otherwise(F.concat(say("difference"), F.coalesce(say("points"), F.lit(""))))
    tail = say("interval")
    again = kind.isin("LAGGED", "SLEEP_DEBT") & (F.abs("reverse") >= F.abs("effect") * 0.8)
    caveats = F.array(F.when(F.col("confidence") == "TENTATIVE", say("tentative")), F.when(F.col("n") < 30, say("short")), F.when(again, say("both_ways")))
    return found.withColumns({"headline": sentence(head), "detail": F.concat(sentence(F.col("strength")), what, tail), "caveats": F.filter(caveats, lambda c: c.isNotNull())}).drop("o_name", "p_name")


def ordinal() -> Column:
    """Place of a candidate: outcomes in the order of their labels; in each correlations, tags and weekdays, these in order too.

    What has no position comes after, by name.
    """
    kind = F.when(F.col("grp").isNull(), 0).when(F.col("kind") == "TAG", 1).otherwise(2)
    day = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.col("grp"))
    last = lambda c: F.coalesce(F.col(c), F.lit(2147483647))
    return F.struct(last("o_position"), F.col("outcome"), kind, last("p_position"), F.coalesce("predictor", F.lit("")), F.coalesce("lag", F.lit(0)), F.when(F.col("kind") == "DAY_OF_WEEK", day).otherwise(last("g_position")), F.coalesce("grp", F.lit("")))


def _labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds names and places of outcome, predictor and tag from the labels; those without are named by their keys."""
    position = F.col("position") if "position" in labels.columns else F.lit(None)
    known = labels.groupBy("metric_key").agg(F.min(F.struct(position.cast("int").alias("position"), "label")).alias("known"))
    for column, short in (("outcome", "o"), ("predictor", "p"), ("grp", "g")):
        own = known.select(F.col("metric_key").alias(column), F.col("known.position").alias(f"{short}_position"), F.col("known.label").alias(f"{short}_name"))
        found = found.join(own, column, "left")
    return found.withColumns({"o_name": F.coalesce("o_name", "outcome"), "p_name": F.coalesce("p_name", "predictor")})


def candidates(outcomes: DataFrame, predictors: DataFrame, tags: DataFrame, t: Thresholds = THRESHOLDS, m: Measures = MEASURES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(candidates, gathered days of correlations, of tag comparisons, of weekday comparisons)."""
    corr, corr_rows = correlation_tests(outcomes, predictors, t, m)
    tag, tag_packed = group_tests(tag_rows(outcomes, tags), "TAG", t, m)
    dow, dow_packed = group_tests(weekday_rows(outcomes), "DAY_OF_WEEK", t, m)
    return corr.unionByName(tag).unionByName(dow), corr_rows, tag_packed, dow_packed


def analyse(outcomes: DataFrame, predictors: DataFrame, tags: DataFrame, labels: DataFrame, t: Thresholds = THRESHOLDS, m: Measures = MEASURES) -> Report:
    """The whole analysis of every subject.

    ``labels``: (metric_key, label), and ``position`` if the order of outcomes, predictors and tags is to settle ties:
    of equal findings of a pair the earlier candidate stays, and equal findings are listed in that order. A candidate
    that half the bootstrap cannot be computed for leaves the family before the correction. ``m``: own statistics.
    """
    inputs = tuple(df.persist(StorageLevel.MEMORY_AND_DISK) for df in (outcomes, predictors, tags))
    found, corr_rows, tag_packed, dow_packed = candidates(outcomes, predictors, tags, t, m)
    tests = scored(found, t).persist(StorageLevel.MEMORY_AND_DISK)
    kept = tests.filter("confidence IS NOT NULL AND strength IS NOT NULL")
    kept = kept.join(intervals(kept, corr_rows, tag_packed.unionByName(dow_packed), t, m), ["subject_id", "test_id"])
    checked = tests.filter("confidence IS NOT NULL AND strength IS NOT NULL AND lag > 0").select("subject_id", "outcome", "predictor", "lag")
    kept = kept.join(reverse_checks(outcomes, predictors, t, checked), ["subject_id", "outcome", "predictor", "lag"], "left")
    kept = _labelled(kept, labels).withColumns({"rank_score": rank_score(F.col("effect"), F.col("confidence")), "pair": pair_of(F.col("test_id")), "ordinal": ordinal()})
    kept = strongest(kept, ["subject_id"], "pair", "rank_score", "ordinal")
    place = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("rank_score"), "ordinal"))
    insights = worded(kept.withColumn("place", place))
    insights = insights.select("subject_id", "place", "test_id", "kind", "headline", "detail", "effect", "ci_low", "ci_high", "n", "confidence", "strength", "caveats", "rank_score")
    return Report(tests, insights, pending(outcomes, predictors, t), (tests, corr_rows, tag_packed, dow_packed), inputs)


def summary(report: Report) -> DataFrame:
    """subject_id, tests_run, findings by label, waiting, message: what stands above a report.

    ``message`` says that nothing stands out where a subject has neither findings nor analyses that wait for days.
    """
    run = report.tests.groupBy("subject_id").agg(F.count(F.lit(1)).cast("int").alias("tests_run"))
    label = confidence_label(F.col("confidence"))
    found = report.insights.groupBy("subject_id").agg(*[F.count_if(label == v).cast("int").alias(k.lower()) for k, v in CONFIDENCE.items()])
    waits = report.pending.groupBy("subject_id").agg(F.count(F.lit(1)).cast("int").alias("waiting"))
    both = run.join(found, "subject_id", "full").join(waits, "subject_id", "full").fillna(0, ["tests_run", "clear", "tentative", "waiting"])
    return both.withColumn("message", F.when(F.col("clear") + F.col("tentative") + F.col("waiting") == 0, NOTHING))
