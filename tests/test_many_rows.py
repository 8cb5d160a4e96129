"""Expressions that once cost some milliseconds a row."""

import time

import pytest
from pyspark.sql import functions as F

from tideline.functions import stats


def test_student_t_of_many_rows(spark):
    """200,000 rows in half a minute; a fold of 300 steps in Spark took some milliseconds a row."""
    at = F.col("id")
    rows = spark.range(0, 200_000, 1, 4).select(at, (at % 97 / 10 - 4).alias("t"), (at % 40 + 1).cast("double").alias("df"))
    rows = rows.select("id", "t", "df", stats.t_survival_of(F.col("t"), F.col("df")).alias("p"))
    stats_of = lambda n: rows.limit(n).agg(F.count("p"), F.min("p"), F.max("p")).first()
    stats_of(10)
    began = time.perf_counter()
    found = rows.agg(F.count("p"), F.sum("p")).first()
    assert time.perf_counter() - began < 30 and found[0] == 200_000
    wide = rows.filter("df = 30").select("p", stats.t_survival(F.col("t"), 30).alias("q")).agg(F.max(F.abs(F.col("p") - F.col("q")))).first()
    assert wide[0] < 1e-10


def test_incomplete_beta_of_odd_values(spark):
    values = [(None, 1.0, 1.0), (0.5, None, 1.0), (0.5, -1.0, 2.0), (0.5, 0.0, 2.0), (-1.0, 1.0, 1.0), (2.0, 1.0, 1.0), (0.25, 1.0, 1.0), (0.25, 3000.0, 9000.0), (1e-3, 1e-3, 40.0)]
    rows = spark.createDataFrame(values, "x double, a double, b double").coalesce(1)
    got = [r[0] for r in rows.select(stats.incomplete_beta(F.col("x"), F.col("a"), F.col("b"))).collect()]
    assert got[:6] == [None, None, None, None, 0.0, 1.0] and got[6] == pytest.approx(0.25)
    assert got[7] == pytest.approx(0.5, abs=0.01) and 0.99 < got[8] < 1
    assert rows.limit(0).select(stats.incomplete_beta(F.col("x"), F.col("a"), F.col("b"))).collect() == []
