"""Statistics as column expressions: usable over groups, windows or rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Over = Callable[[Column], Column]


def _same(c: Column) -> Column:
    return c


def sample_sd(x: Column, over: Over = _same) -> Column:
    """Sample standard deviation; 0 for fewer than two values."""
    return F.coalesce(over(F.stddev_samp(x)), F.lit(0.0))


def pearson(x: Column, y: Column, over: Over = _same) -> Column:
    """Null for fewer than three pairs or no variance, held to [-1, 1]."""
    n, both = over(F.count(F.lit(1))), over(F.covar_pop(x, y))
    spread = F.sqrt(over(F.var_pop(x)) * over(F.var_pop(y)))
    usable = (n >= 3) & (spread * n > 1e-12)
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), both / F.when(usable, spread))))


def mean_difference(x: Column, inside: Column, over: Over = _same) -> Column:
    return over(F.avg(F.when(inside, x))) - over(F.avg(F.when(~inside, x)))


def standardised_difference(x: Column, inside: Column, over: Over = _same) -> Column:
    """Mean difference by the standard deviation of all values; null where that is nothing."""
    sd = sample_sd(x, over)
    return F.when(sd > 1e-9, mean_difference(x, inside, over) / F.when(sd > 1e-9, sd))


def fisher_z(r: Column) -> Column:
    return F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r)))


def inverse_fisher_z(z: Column) -> Column:
    return F.tanh(z)


# The polynomial of the error function (Abramowitz and Stegun 7.1.26).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Coefficients from the highest power down."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_P * x)
    erf = 1 - _horner(t, ERF[::-1]) * t * F.exp(-x * x)
    return 0.5 * (1 + F.when(z < 0, -erf).otherwise(erf))


# Acklam's rational approximation of the normal quantile, middle and tails.
MIDDLE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MIDDLE_LOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_LOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def normal_quantile(p: Column) -> Column:
    """Null outside (0, 1)."""
    q = p - 0.5
    middle = _horner(q * q, MIDDLE_TOP) * q / _horner(q * q, MIDDLE_LOW)

    def tail(x: Column) -> Column:
        r = F.sqrt(-2 * F.ln(x))
        return _horner(r, TAIL_TOP) / _horner(r, TAIL_LOW)

    return F.when((p > 0) & (p < TAIL), tail(p)).when((p >= TAIL) & (p <= 1 - TAIL), middle).when((p > 1 - TAIL) & (p < 1), -tail(1 - p))


NULL_DF = 30


def t_survival(t: Column, df: int = NULL_DF) -> Column:
    """P(T > t) for a whole number of degrees of freedom, by the finite cosine series."""
    theta = F.atan(F.abs(t) / math.sqrt(df))
    odd = df % 2
    terms = [1.0]
    for j in range(1, (df - odd) // 2):
        terms.append(terms[-1] * (2 * j - 1 + odd) / (2 * j + odd))
    series = _horner(F.cos(theta) * F.cos(theta), tuple(terms[::-1]))
    if odd:
        inside = 2 / math.pi * (theta + (F.sin(theta) * F.cos(theta) * series if df > 1 else F.lit(0.0)))
    else:
        inside = F.sin(theta) * series
    half = F.greatest(F.lit(0.0), (1 - inside) / 2)
    return F.when(t < 0, 1 - half).otherwise(half)


# Lanczos' coefficients for ln Gamma with g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-06, 1.5056327351493116e-07)


def ln_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0; null otherwise."""

    def upper(z: Column) -> Column:  # of z + 1
        total = F.lit(LANCZOS[0])
        for k, c in enumerate(LANCZOS[1:], 1):
            total = total + c / (z + k)
        return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(z + 7.5) - (z + 7.5) + F.ln(total)

    return F.when(x > 0, upper(x) - F.ln(x))


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """The same as ``ln_gamma`` for x > 0."""
    z, total = x, np.full(len(x), LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (z + k)
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(z + 7.5) - (z + 7.5) + np.log(total) - np.log(x)


#: Rows leave the continued fraction when two steps in a row change them by no more than this, looked at every so many steps.
SETTLED, LOOK = 4 * np.finfo(float).eps, 8


def _fraction(y: np.ndarray, p: np.ndarray, q: np.ndarray, steps: int) -> np.ndarray:
    """The continued fraction of the incomplete beta, by Lentz's method, for all rows at once."""
    sure = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    out, at = np.ones(len(y)), np.arange(len(y))
    c, d, h = np.full(len(y), 1e300), np.ones(len(y)), np.ones(len(y))
    for k in range(1, steps + 1):
        m = float(k // 2)
        n = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)) if k % 2 else m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / sure(1 + n * d), sure(1 + n / c)
        h = h * c * d
        if k % LOOK == LOOK - 1:
            moved = np.abs(c * d - 1)
        elif k % LOOK == 0:
            more = np.maximum(moved, np.abs(c * d - 1)) > SETTLED
            if not more.all():
                out[at] = h
                at, y, p, q, c, d, h = (v[more] for v in (at, y, p, q, c, d, h))
                if not len(at):
                    break
    out[at] = h
    return out


def incomplete_beta(x: Column, a: Column, b: Column, steps: int = 300) -> Column:
    """Regularised incomplete beta I_x(a, b) by the continued fraction, evaluated on the side where it converges fast.

    Null unless a and b are positive. Spark hands over batches of rows, and numpy takes a step of the fraction for all of them
    at once; as a fold in Spark, it built a row in interpreted code for each step of each row.
    """

    @F.arrow_udf("double")
    def inside(x: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        missing = [v.is_null().to_numpy(zero_copy_only=False) for v in (x, a, b)]
        x, a, b = (v.to_numpy(zero_copy_only=False).astype(float) for v in (x, a, b))
        with np.errstate(all="ignore"):
            swap = x > (a + 1) / (a + b + 2)
            y, p, q = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
            front = np.exp(_ln_gamma(p + q) - _ln_gamma(p) - _ln_gamma(q) + p * np.log(y) + q * np.log(1 - y)) / p
            found = front * _fraction(y, p, q, steps)
            none = np.logical_or.reduce([p <= 0, q <= 0, y <= 0, y >= 1, *missing])
            return pa.array(np.where(swap, 1 - found, found), mask=none)

    found = inside(x.cast("double"), a.cast("double"), b.cast("double"))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(found)


def t_survival_of(t: Column, df: Column) -> Column:
    """P(T > t) for any positive degrees of freedom, also broken ones."""
    half = 0.5 * incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5))
    return F.when(t < 0, 1 - half).otherwise(half)


def p_against_null(effect: Column, null_sd: Column) -> Column:
    """Two-sided p of an effect, on its transformed scale, against the null's standard deviation."""
    usable = effect.isNotNull() & ~F.isnan(effect) & (null_sd > 1e-12)
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * t_survival(F.abs(effect) / F.when(usable, null_sd))))).otherwise(1.0)


def bootstrap_p(effect: Column, standard_error: Column) -> Column:
    usable = standard_error > 1e-12
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (1 - normal_cdf(F.abs(effect) / F.when(usable, standard_error))))))


def block_length(n: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.greatest(F.lit(2), F.floor(n / 2)), F.floor(F.cbrt(n) + 0.5))).cast("int")


def rotation_margin(n: Column) -> Column:
    """Least distance of a rotation from none; rotations are from the margin up to n minus it, exclusive."""
    return F.greatest(F.lit(3), F.floor(n / 20)).cast("int")


#: Factor and mask of the mix; no product reaches 2^63.
MIX_FACTOR, MIX_MASK = 0x45D9F3B, (1 << 32) - 1


def mixed(x: Column) -> Column:
    """A mix of whole numbers below 2^32, by two rounds of shift and product."""
    shift = lambda v: v.bitwiseXOR(F.shiftright(v, 16))
    turn = lambda v: (shift(v) * F.lit(MIX_FACTOR).cast("long")).bitwiseAND(F.lit(MIX_MASK).cast("long"))
    return F.get(F.transform(F.transform(F.transform(F.array(x.cast("long")), turn), turn), shift), 0)


def mixed_draw(seed: int, test: Column, *indices: Column) -> Column:
    """A number in [0, 2^32) from (seed, test) and whole-number indices; it depends on nothing else.

    The text is hashed once, each index costs a few whole-number operations, and numpy and SQL compute the same.
    """
    out = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), test).cast("binary")), 1, 8), 16, 10).cast("long")
    for i in indices:
        out = mixed(out.bitwiseXOR(i.cast("long")))
    return out


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 2^32) that depends on nothing but its parts, so it is the same in any order and partition."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(seed: int, *parts: Column) -> Column:
    return draw(seed, *parts) / 4294967296.0


def gaussian(seed: int, *parts: Column) -> Column:
    """Box and Muller's transform of two draws."""
    u1, u2 = uniform(seed, *parts, F.lit("a")), uniform(seed, *parts, F.lit("b"))
    return F.sqrt(-2 * F.ln(F.greatest(F.lit(1e-12), u1))) * F.cos(2 * math.pi * u2)
