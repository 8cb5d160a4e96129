"""Weekly periodicity: autocorrelation seven days apart against a null that keeps slow drift.

Each series is cleared of slow drift by its centred mean, as tests are, and correlated with itself seven calendar days
before; only pairs of observed days count, so gaps shift nothing. The null deals the values of every stretch of
``block`` calendar days anew among the days observed in it: what moves slower than a stretch stays where it is, what
repeats by weekday is lost. Draws are whole-number mixes of (test, draw, day), which SQL computes as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.stats import fisher_z, p_against_null
from tideline.operators.nulls import draws, row_correlations
from tideline.operators.resample import gathered
from tideline.operators.residuals import adjusted
from tideline.schema import THRESHOLDS, Thresholds

LAG, BLOCK = 7, 14


def weekly(series: DataFrame, t: Thresholds = THRESHOLDS, lag: int = LAG, block: int = BLOCK) -> DataFrame:
    """subject_id, metric_key, days, pairs, effect, null_sd, p of series with ``t.min_days_lagged`` days or more.

    ``effect`` is null without ``min_days_same_day`` pairs or without spread, ``null_sd`` where half the draws have none.
    """
    keys = ["subject_id", "metric_key"]
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    long_enough = series.filter("value IS NOT NULL AND day IS NOT NULL").withColumn("n", n).filter(F.col("n") >= t.min_days_lagged).drop("n")
    rows = adjusted(long_enough.withColumn("weekend", F.lit(0)), keys, "value", "res", weekend=None, window=t.detrend_window)
    packed = gathered(rows.withColumn("test_id", F.concat(F.lit("weekly:"), "metric_key")), [*keys, "test_id"], ["res"])
    schema = "subject_id string, metric_key string, days int, pairs int, effect double, null_sd double"

    def one(subject: str, test: str, day: np.ndarray, res: np.ndarray) -> tuple[int, float | None, float | None]:
        at = np.searchsorted(day, day - lag)
        later = np.nonzero(day[np.minimum(at, len(day) - 1)] == day - lag)[0]
        earlier = at[later]
        if len(later) < t.min_days_same_day:
            return len(later), None, None
        effect = row_correlations(res[None, later], res[None, earlier])[0]
        key = draws(t.seed, f"{subject}|{test}", np.arange(t.null_samples)[:, None], day[None, :])
        stretch = (day - day[0]) // block
        order = np.lexsort((np.broadcast_to(day, key.shape), key, np.broadcast_to(stretch, key.shape)), axis=1)
        dealt = res[order]
        null = row_correlations(dealt[:, later], dealt[:, earlier])
        null = np.arctanh(np.clip(null[np.isfinite(null)], -0.999999, 0.999999))
        sd = float(null.std(ddof=1)) if len(null) >= max(2, t.null_samples // 2) else 0.0
        return len(later), float(effect) if np.isfinite(effect) else None, sd if sd > 1e-12 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            subjects, names, tests = (b.column(j).to_pylist() for j in range(3))
            rows = b.column(3)
            ends, day, res = rows.offsets.to_numpy(), rows.values.field("day").cast(pa.int32()).to_numpy(), rows.values.field("res").to_numpy(zero_copy_only=False)
            out = []
            for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                out.append((subjects[k], names[k], hi - lo, *one(subjects[k], tests[k], day[lo:hi].astype(np.int64), res[lo:hi])))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)], names=["subject_id", "metric_key", "days", "pairs", "effect", "null_sd"])

    found = packed.select(*keys, "test_id", "rows").mapInArrow(run, schema)
    return found.withColumn("p", F.when(F.col("effect").isNotNull() & F.col("null_sd").isNotNull(), p_against_null(fisher_z(F.col("effect")), F.col("null_sd"))))
