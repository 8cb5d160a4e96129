"""How often the analysis is wrong on noise and right on planted effects; its order, its drops, and own statistics."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import nulls
from tideline.operators.association import tag_rows
from tideline.plans import engine
from tideline.schema import Thresholds
from tideline.sources import tables

START = dt.date(2026, 1, 5)
FEWER = Thresholds(replicates=400)
SERIES = "subject_id string, metric_key string, day date, value double"
TAGS = "subject_id string, tag string, day date"


def scale(x):
    return np.clip(np.floor(x + 0.5), -3, 3)


def frames(spark, runs):
    """(outcomes, predictors, tags, labels) of runs: name to (outcomes, predictors, tags), each key to values by day or days."""
    rows = ([], [], [])
    for name, (outcomes, predictors, tags) in runs.items():
        for side, own in ((rows[0], outcomes), (rows[1], predictors)):
            side += [(name, k, START + dt.timedelta(i), float(v)) for k, values in own.items() for i, v in enumerate(values) if not math.isnan(v)]
        rows[2].extend((name, t, START + dt.timedelta(int(i))) for t, days in tags.items() for i in days)
    return (*(spark.createDataFrame(r, SERIES) for r in rows[:2]), spark.createDataFrame(rows[2], TAGS), tables.metric_labels(spark))


def insights(report):
    return [r.asDict() for r in report.insights.orderBy("subject_id", "place").collect()]


def test_noise_rarely_gives_findings(spark):
    """Runs of 100 days, two outcomes and three predictors: of each 20 at most 5 have findings, and at most one is confident.

    60 runs, as the second rate is one that a single 20 may miss by chance; over 200 runs 9 had findings, 4 confident ones.
    """
    r = np.random.default_rng(11)
    runs = {f"r{k}": ({"mood": scale(r.normal(size=100)), "energy": scale(r.normal(size=100))}, {"sleep_minutes": 420 + 55 * r.normal(size=100), "screen_minutes": 250 + 60 * r.normal(size=100), "steps": 7000 + 2000 * r.normal(size=100)}, {}) for k in range(60)}
    found = insights(engine.analyse(*frames(spark, runs), FEWER))
    assert len({f["subject_id"] for f in found}) <= 15 and sum(f["confidence"] == "CLEAR" for f in found) <= 3


def lagged(r, days, beta, noise, steps=False):
    sleep = 420 + 55 * r.normal(size=days)
    z = np.concatenate([np.zeros(2), (sleep[:-2] - 420) / 55])
    predictors = {"sleep_minutes": sleep} | ({"steps": 7000 + 2500 * r.normal(size=days)} if steps else {})
    return {"mood": scale(beta * z + noise * r.normal(size=days))}, predictors, {}


def test_planted_lag_is_found(spark):
    """20 runs of 100 days: at least 17 at lag 2, positive."""
    r = np.random.default_rng(12)
    runs = {f"r{k}": lagged(r, 100, 0.7, 0.8) for k in range(20)} | {"long": lagged(r, 150, 1.1, 0.7, True)}
    found = insights(engine.analyse(*frames(spark, runs), FEWER))
    right = {f["subject_id"] for f in found if f["test_id"] == "corr:mood:sleep_minutes:lag2" and f["effect"] > 0}
    assert len(right - {"long"}) >= 17
    [own] = [f for f in found if f["subject_id"] == "long" and f["test_id"].startswith("corr:mood:sleep_minutes")]
    assert own["test_id"].endswith(":lag2") and own["confidence"] == "CLEAR" and own["effect"] > 0 and "not evidence of cause" in own["detail"]


def test_weekends_and_tags(spark):
    """A weekend effect on both sides is a weekday pattern and no association; a tag's effect is found."""
    r = np.random.default_rng(13)
    we = np.array([(START + dt.timedelta(i)).weekday() >= 5 for i in range(140)], float)
    alcohol = r.random(120) < 0.2
    runs = {
        "weekend": ({"mood": scale(1.3 * we + 0.6 * r.normal(size=140))}, {"screen_minutes": 250 + 170 * we + 40 * r.normal(size=140)}, {}),
        "tag": ({"mood": scale(-1.4 * alcohol + 0.6 * r.normal(size=120))}, {}, {"alcohol": np.nonzero(alcohol)[0]}),
    }
    found = insights(engine.analyse(*frames(spark, runs), FEWER))
    assert {f["kind"] for f in found if f["subject_id"] == "weekend"} == {"DAY_OF_WEEK"}
    [own] = [f for f in found if f["subject_id"] == "tag" and f["kind"] == "TAG"]
    assert own["effect"] < 0 and '"alcohol"' in own["headline"]


def test_candidates_without_a_bootstrap_leave_the_family(spark):
    """A tag on the first four days of 300, where few blocks begin, is in fewer than half the replicates: it is no candidate and does not count."""
    r = np.random.default_rng(14)
    run = ({"mood": scale(r.normal(size=300))}, {}, {"rare": [0, 1, 2, 3], "often": np.arange(0, 300, 3)})
    outcomes, predictors, tags, labels = frames(spark, {"a": run})
    packed, _ = engine.group_tests(tag_rows(outcomes, tags), "TAG", FEWER)[1], None
    counted = packed.select("grp", F.aggregate("rows", F.lit(0), lambda a, x: a + x["inside"]).alias("k")).collect()
    assert {(x["grp"], x["k"]) for x in counted} == {("rare", 4), ("often", 100)}  # both pass their gates
    tests = {x["test_id"]: x["family"] for x in engine.analyse(outcomes, predictors, tags, labels, FEWER).tests.collect()}
    assert "tag:mood:often" in tests and "tag:mood:rare" not in tests and set(tests.values()) == {8}
    days, inside = np.arange(300), np.isin(np.arange(300), [0, 1, 2, 3]).astype(np.int32)
    drawn = nulls.differences(r.normal(size=300)[nulls._places(300, "t", FEWER, nulls.draws)], inside[nulls._places(300, "t", FEWER, nulls.draws)])
    assert np.isfinite(drawn).sum() < 200 and not nulls.can_be_drawn("t", r.normal(size=300), inside, FEWER, nulls.differences, nulls.draws)
    assert nulls.can_be_drawn("t", r.normal(size=300), (days % 2).astype(np.int32), FEWER, nulls.differences, nulls.draws)


def test_ties_keep_the_order_of_examination(spark):
    """Equal findings are listed by the order of outcomes and predictors, not by their names; the shorter lag stays of a pair."""
    r = np.random.default_rng(15)
    x = np.cumsum(r.normal(size=120))
    y = x + 0.3 * r.normal(size=120)
    outcomes, predictors, tags, labels = frames(spark, {"a": ({"mood": y, "energy": y}, {"steps": x, "hrv": x, "exercise_minutes": x}, {})})
    found = insights(engine.analyse(outcomes, predictors, tags, labels, FEWER))
    assert [(f["test_id"].split(":")[1:3]) for f in found] == [[o, p] for o in ("mood", "energy") for p in ("steps", "exercise_minutes", "hrv")]
    assert len({f["effect"] for f in found}) == 1
    other = labels.drop("position")  # without positions by name
    assert [f["test_id"].split(":")[1] for f in insights(engine.analyse(outcomes, predictors, tags, other, FEWER))][:3] == ["energy"] * 3


def test_an_own_statistic_runs_through_the_analysis(spark):
    """Plain correlation on its own scale: effect, null, correction, interval and the way back all use it."""
    r = np.random.default_rng(16)
    inputs = frames(spark, {"a": lagged(r, 150, 1.1, 0.7)})
    own = nulls.Measures(correlation=nulls.row_correlations, transform=lambda v: 10 * v, inverse=lambda v: v / 10)
    report = engine.analyse(*inputs, FEWER, own)
    tests = {x["test_id"]: x for x in report.tests.collect()}
    best = tests["corr:mood:sleep_minutes:lag2"]
    [row] = engine.gathered_pairs(*inputs[:2]).filter("lag = 2").collect()
    x, y = (np.array([v[c] for v in row["rows"]]) for c in ("rx", "ry"))
    assert best["effect"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and best["scaled"] == pytest.approx(10 * best["effect"]) and best["confidence"] == "CLEAR"
    [found] = [f for f in insights(report) if f["test_id"] == "corr:mood:sleep_minutes:lag2"]
    places = nulls._places(len(x), "corr:mood:sleep_minutes:lag2", FEWER, nulls.draws)
    se = (10 * nulls.row_correlations(x[places], y[places])).std(ddof=1)
    assert (found["ci_high"] - found["ci_low"]) / 2 == pytest.approx(engine.Z_DISPLAY * se / 10)
    assert tests["corr:mood:sleep_minutes:lag0"]["effect"] != {x["test_id"]: x for x in engine.analyse(*inputs, FEWER).tests.collect()}["corr:mood:sleep_minutes:lag0"]["effect"]
