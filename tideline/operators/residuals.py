"""Adjusting a series for weekends and slow drift by least squares, in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.windows import centred_mean
from tideline.schema import THRESHOLDS


def residuals(y: str, covariates: list[str], keys: list[str]) -> Column:
    """Residuals of ``y`` on an intercept and one or two covariates, within each key.

    Covariates without variance are left out; with no more rows than coefficients, or covariates
    that determine each other, ``y`` stays as it is. Only window aggregates over the keys are
    used, so the trend, this and the ranks share one shuffle.
    """
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)

    def moment(a: str, b: str) -> Column:
        return F.covar_pop(a, b).over(w) * n

    def centred(a: str) -> Column:
        return F.col(a) - F.avg(a).over(w)

    varies = {c: F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0)) > 1e-12 for c in covariates}

    def one(c: str) -> Column:
        return F.when((n > 2) & (moment(c, c) >= 1e-10), centred(y) - centred(c) * moment(c, y) / F.nullif(moment(c, c), F.lit(0.0))).otherwise(F.col(y))

    alone = centred(y)
    if len(covariates) == 1:
        return F.when(varies[covariates[0]], one(covariates[0])).otherwise(F.when(n > 1, alone).otherwise(F.col(y)))
    a, b = covariates
    det = moment(a, a) * moment(b, b) - moment(a, b) * moment(a, b)
    usable = (n > 3) & (det >= 1e-10 * F.greatest(moment(a, a), moment(b, b)))
    safe = F.when(usable, det)
    slope_a = (moment(a, y) * moment(b, b) - moment(b, y) * moment(a, b)) / safe
    slope_b = (moment(b, y) * moment(a, a) - moment(a, y) * moment(a, b)) / safe
    both = F.when(usable, centred(y) - slope_a * centred(a) - slope_b * centred(b)).otherwise(F.col(y))
    return F.when(varies[a] & varies[b], both).when(varies[a], one(a)).when(varies[b], one(b)).otherwise(F.when(n > 1, alone).otherwise(F.col(y)))


def residuals_of_many(df: DataFrame, y: str, covariates: list[str], keys: list[str], out: str) -> DataFrame:
    """Adds ``out``: residuals of ``y`` on an intercept and any number of covariates, within each key.

    The covariates are made orthogonal one after another, each by one window over the keys, so all
    share a shuffle and a sort; a key's rows are one task's work, as for every series. Covariates
    without variance are left out of that key. With no more rows than coefficients, or a covariate
    that the earlier ones determine, ``y`` stays as it is. Rows with a null in ``y`` or a covariate
    take no part and get null.
    """
    w = Window.partitionBy(*keys)
    columns = [y, *covariates]
    own = {c: f"__res{k}" for k, c in enumerate(columns)}
    varies = {c: f"__var{k}" for k, c in enumerate(covariates)}
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    df = df.withColumns({own[c]: F.when(whole, F.col(c).cast("double")) for c in columns})
    df = df.withColumns({"__rows": F.count(own[y]).over(w), **{varies[c]: F.coalesce(F.stddev_samp(own[c]).over(w), F.lit(0.0)) > 1e-12 for c in covariates}, **{v: F.col(v) - F.avg(v).over(w) for v in own.values()}})
    coefficients = sum((F.col(v).cast("int") for v in varies.values()), F.lit(1))
    df = df.withColumn("__usable", F.col("__rows") > coefficients)
    for k, c in enumerate(covariates):
        a = own[c]
        rest = [own[y], *(own[b] for b in covariates[k + 1 :])]
        pivot = F.when(F.col(varies[c]), F.sum(F.col(a) * F.col(a)).over(w))
        slopes = {f"__slope{i}": F.sum(F.col(a) * F.col(b)).over(w) for i, b in enumerate(rest)}
        df = df.withColumns({"__pivot": pivot, **slopes})
        fits = F.col("__pivot") >= 1e-10
        df = df.withColumns({"__usable": F.col("__usable") & (~F.col(varies[c]) | fits), **{b: F.when(fits, F.col(b) - F.col(f"__slope{i}") / F.col("__pivot") * F.col(a)).otherwise(F.col(b)) for i, b in enumerate(rest)}})
        df = df.drop("__pivot", *slopes)
    value = F.when(F.col("__usable"), F.col(own[y])).when(F.col(own[y]).isNotNull(), F.col(y))
    return df.withColumn(out, value.cast("double")).drop("__rows", "__usable", *own.values(), *varies.values())


def adjusted(df: DataFrame, keys: list[str], value: str, out: str, weekend: str | None = "weekend", window: int = THRESHOLDS.detrend_window, day: str = "day") -> DataFrame:
    """Adds ``out``: residuals on the weekend, if given, and the series' own centred mean, rounded to nine places.

    The rounding keeps ranks from being told apart by the last bits of a sum.
    """
    df = df.withColumn("__trend", centred_mean(value, keys, window, day))
    return df.withColumn(out, F.round(residuals(value, [weekend, "__trend"] if weekend else ["__trend"], keys), 9)).drop("__trend")
