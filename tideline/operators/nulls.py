"""Null models and bootstrap of gathered tests, a test at a time in numpy.

Written as relations (see ``resample``), the draws multiply every test's days a
hundredfold or more before they are aggregated again. Here a test's array row
stays where it is: draws are matrices of (draw, day) inside one task, Arrow
batches carry the rows in and one number per test out, and no shuffle is added
to the one that gathers the days. A matrix is bounded by draws times days.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tideline.functions.stats import MIX_FACTOR, MIX_MASK
from tideline.schema import THRESHOLDS, Thresholds

#: Two matrices of (draw, day) to one number per draw.
Statistic = Callable[[np.ndarray, np.ndarray], np.ndarray]


def mixed(x: np.ndarray) -> np.ndarray:
    """``functions.stats.mixed`` of whole numbers below 2^32."""
    for _ in range(2):
        x = ((x ^ (x >> 16)) * MIX_FACTOR) & MIX_MASK
    return x ^ (x >> 16)


def draws(seed: int, test: str, *indices: np.ndarray | range | int) -> np.ndarray:
    """The numbers below 2^32 that ``functions.stats.mixed_draw`` gives for the same parts; indices broadcast."""
    out = np.array(int(hashlib.md5(f"{seed}|{test}".encode()).hexdigest()[:8], 16), np.int64)
    for i in indices:
        out = mixed(out ^ (np.asarray(i, np.int64) & MIX_MASK))
    return out


def block_size(n: int) -> int:
    return int(max(2, min(max(2, n // 2), np.floor(np.cbrt(n) + 0.5))))


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks within each row; ties share the mean of their places."""
    out = np.empty(x.shape)
    for k, row in enumerate(x):
        s = np.sort(row)
        out[k] = (np.searchsorted(s, row, "left") + np.searchsorted(s, row, "right") + 1) / 2
    return out


def row_correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of each row of ``a`` with that of ``b``; NaN without variance or for fewer than three columns."""
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    spread = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    usable = (spread > 1e-12) & (a.shape[1] >= 3)
    return np.where(usable, np.clip((a * b).sum(1) / np.where(usable, spread, 1), -1, 1), np.nan)


def detrended(x: np.ndarray, days: np.ndarray, weekend: np.ndarray, window: int) -> np.ndarray:
    """Residuals of each row on the weekend and its own centred mean, by the rules of ``residuals.residuals``."""
    n = x.shape[1]
    lo, hi = np.searchsorted(days, days - window // 2, "left"), np.searchsorted(days, days + window // 2, "right")
    centre = x.mean(1, keepdims=True)  # sums of deviations lose less than sums of values
    sums = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x - centre, 1)], 1)
    t = (sums[:, hi] - sums[:, lo]) / (hi - lo)
    y, t = x - centre, t - t.mean(1, keepdims=True)
    w = (weekend - weekend.mean())[None, :]
    sww, stt, swt = (w * w).sum(), (t * t).sum(1), (t * w).sum(1)
    swy, sty = (y * w).sum(1), (y * t).sum(1)
    vw, vt = np.sqrt(sww / max(n - 1, 1)) > 1e-12, np.sqrt(stt / max(n - 1, 1)) > 1e-12
    det = sww * stt - swt * swt
    safe = np.where(det == 0, 1, det)
    both = y - ((swy * stt - sty * swt) / safe)[:, None] * w - ((sty * sww - swy * swt) / safe)[:, None] * t
    both = np.where(((n > 3) & (det >= 1e-10 * np.maximum(sww, stt)))[:, None], both, x)
    trend = np.where(((n > 2) & (stt >= 1e-10))[:, None], y - (sty / np.where(stt == 0, 1, stt))[:, None] * t, x)
    flat = y if n > 1 else x
    if not vw:
        return np.round(np.where(vt[:, None], trend, flat), 9)
    only = y - (swy / sww)[:, None] * w if n > 2 and sww >= 1e-10 else x
    return np.round(np.where(vt[:, None], both, only), 9)


def _rows(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    rows = batch.column(batch.schema.get_field_index("rows"))
    ends, items = rows.offsets.to_numpy(), rows.values
    flat = {c: (items.field(c).cast(pa.int32()) if c == "day" else items.field(c)).to_numpy(zero_copy_only=False) for c in columns}
    for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        yield k, {c: v[lo:hi] for c, v in flat.items()}


def _mapped(packed: DataFrame, keys: list[str], columns: list[str], out: list[tuple[str, str]], work: Callable[[str, dict[str, np.ndarray]], tuple]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    types = {"double": pa.float64(), "string": pa.string(), "int": pa.int32()}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{n} {t}" for n, t in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.get_field_index("test_id")).to_pylist()
            found = [work(ids[k], rows) for k, rows in _rows(b, columns)]
            cols = [b.column(b.schema.get_field_index(k)) for k in keys] + [pa.array([f[j] for f in found], types[t]) for j, (_, t) in enumerate(out)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, *(n for n, _ in out)])

    return packed.select(*keys, "rows").mapInArrow(run, schema)


def _z(r: np.ndarray) -> np.ndarray:
    return np.arctanh(np.clip(r, -0.999999, 0.999999))


def _spread(values: np.ndarray, least: float, ddof: int) -> float | None:
    valid = values[np.isfinite(values)]
    if len(valid) < max(least, ddof + 1):
        return None
    sd = float(valid.std(ddof=ddof))
    return sd if sd > 1e-12 else None


def rank_correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank correlation of each row of ``a`` with that of ``b``, which may have one row for all."""
    return row_correlations(average_ranks(a), average_ranks(b))


def _places(n: int, test: str, t: Thresholds, draw: Callable[..., np.ndarray]) -> np.ndarray:
    """A row of ``n`` places for each replicate of the block bootstrap."""
    size = block_size(n)
    starts = draw(t.seed, test, np.arange(t.replicates)[:, None], np.arange(-(-n // size))[None, :]) % (n - size + 1)
    i = np.arange(n)
    return starts[:, i // size] + i % size


def _always_varies(x: np.ndarray, size: int) -> bool:
    """True if no ``size`` neighbours are equal, so that every replicate, which holds a whole block, varies."""
    changes = np.concatenate([[0], np.cumsum(np.diff(x) != 0)])
    return bool(len(x) >= size and (changes[size - 1 :] > changes[: len(x) - size + 1]).all())


def can_be_drawn(test: str, a: np.ndarray, b: np.ndarray, t: Thresholds, statistic: Statistic, draw: Callable[..., np.ndarray]) -> bool:
    """Whether half the bootstrap's replicates have a statistic: only such tests are candidates. Cheap where that is certain."""
    n = len(a)
    if n < 6:
        return False
    size = block_size(n)
    if statistic in (rank_correlations, differences) and _always_varies(a, size) and _always_varies(b, size):
        return True
    place = _places(n, test, t, draw)
    return int(np.isfinite(statistic(a[place], b[place])).sum()) >= t.replicates // 2


def _rotation_spread(test: str, rows: dict[str, np.ndarray], t: Thresholds, statistic: Statistic, transform: Callable[[np.ndarray], np.ndarray], draw: Callable[..., np.ndarray]) -> tuple[float | None, str | None]:
    n = len(rows["day"])
    m = max(3, n // 20)
    room = n - 2 * m
    if room < 8 or not can_be_drawn(test, rows["rx"], rows["ry"], t, statistic, draw):
        return None, None
    exact = n <= t.exact_null_days
    k = np.arange(m, n - m) if exact else m + draw(t.seed, test, range(t.null_samples)) % room
    x = detrended(rows["x"][(np.arange(n)[None, :] + k[:, None]) % n], rows["day"], rows["weekend"].astype(float), t.detrend_window)
    r = statistic(x, rows["ry"][None, :])
    return _spread(transform(r), len(k) / 2, 0 if exact else 1), "exact" if exact else "sampled"


_NULL = [("null_sd", "double"), ("null_method", "string")]


def rotation_null(
    packed: DataFrame, keys: list[str], t: Thresholds = THRESHOLDS, statistic: Statistic = rank_correlations, transform: Callable[[np.ndarray], np.ndarray] = _z, draw: Callable[..., np.ndarray] = draws
) -> DataFrame:
    """(keys, null_sd, null_method): spread of the statistic, on its scale, under rotations of the raw predictor, each adjusted anew.

    Over all rotations, where there are few, it is the population's; over draws the sample's. Tests without room for
    rotations, or that ``can_be_drawn`` refuses, have no row. ``statistic`` takes two matrices and gives a number per row,
    NaN for none; ``transform`` puts it on the scale of the null; ``draw`` gives whole numbers below 2^32 for (seed, test, indices).
    """
    work = lambda test, rows: _rotation_spread(test, rows, t, statistic, transform, draw)
    return _mapped(packed, keys, ["day", "weekend", "x", "rx", "ry"], _NULL, work).filter("null_method IS NOT NULL")


def differences(values: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Standardised difference of each row between places inside and not; NaN without both or without spread."""
    n, k = inside.shape[1], inside.sum(1)
    sd = values.std(1, ddof=1)
    usable = (k > 0) & (k < n) & (sd > 1e-9)
    total = (values * inside).sum(1)
    return np.where(usable, (total / np.maximum(k, 1) - (values.sum(1) - total) / np.maximum(n - k, 1)) / np.where(usable, sd, 1), np.nan)


def _block_spread(test: str, rows: dict[str, np.ndarray], t: Thresholds, statistic: Statistic, draw: Callable[..., np.ndarray]) -> tuple[float | None, str | None]:
    n = len(rows["day"])
    if not can_be_drawn(test, rows["ry"], rows["inside"], t, statistic, draw):
        return None, None
    mean = max(1, min(block_size(n), max(1, n // 2)))
    pos = np.arange(n)[None, :]
    starts = (pos == 0) | (draw(t.seed, test, np.arange(t.null_samples)[:, None], pos) / 2**32 <= 1.0 / mean)
    block = np.cumsum(starts, 1)
    at = np.nonzero(starts)
    place = np.zeros((t.null_samples, n + 1), np.int64)
    place[at[0], block[at]] = draw(t.seed, test, at[0], block[at], 1)
    keyed = np.take_along_axis(place, block, 1)
    # One sort for three keys: equal draws fall back on the block, equal blocks on the place, both below 2^31.
    order = np.argsort(keyed * (n + 1) + block, axis=1, kind="stable")
    stat = statistic(rows["ry"][order], np.broadcast_to(rows["inside"], order.shape))
    return _spread(stat, t.null_samples // 2, 1), "blocks"


def block_null(packed: DataFrame, keys: list[str], t: Thresholds = THRESHOLDS, statistic: Statistic = differences, draw: Callable[..., np.ndarray] = draws) -> DataFrame:
    """(keys, null_sd, null_method): spread of the statistic under block permutation of the values; it takes the values and the places inside.

    Each place after the first starts a block with probability 1 / mean length; blocks are shuffled whole. Tests that
    ``can_be_drawn`` refuses have no row.
    """
    return _mapped(packed, keys, ["day", "ry", "inside"], _NULL, lambda test, rows: _block_spread(test, rows, t, statistic, draw)).filter("null_method IS NOT NULL")


def bootstrap_error(
    packed: DataFrame, keys: list[str], grouped: bool, t: Thresholds = THRESHOLDS, statistic: Statistic | None = None, transform: Callable[[np.ndarray], np.ndarray] | None = None, draw: Callable[..., np.ndarray] = draws
) -> DataFrame:
    """(keys, se): standard error of the statistic, on its scale, over the block bootstrap; no row where half the draws have none.

    By default the standardised difference of comparisons, and Fisher's z of the rank correlation of others.
    """
    measure = statistic or (differences if grouped else rank_correlations)
    scale = transform or ((lambda x: x) if grouped or statistic else _z)
    first, second = ("ry", "inside") if grouped else ("rx", "ry")

    def work(test: str, rows: dict[str, np.ndarray]) -> tuple:
        n = len(rows[first])
        if n < 6:
            return (None,)
        place = _places(n, test, t, draw)
        stat = scale(measure(rows[first][place], rows[second][place]))
        return (_spread(stat, t.replicates // 2, 1),)

    return _mapped(packed, keys, ["day", first, second], [("se", "double")], work).filter("se IS NOT NULL")


@dataclass(frozen=True)
class Measures:
    """What an analysis measures with, in numpy: statistics of two matrices by row, the scale of the null and back, and draws.

    ``correlation`` takes adjusted predictor and outcome, ``difference`` adjusted outcome and places inside.
    """

    correlation: Statistic = rank_correlations
    transform: Callable[[np.ndarray], np.ndarray] = _z
    inverse: Callable[[np.ndarray], np.ndarray] = np.tanh
    difference: Statistic = differences
    draw: Callable[..., np.ndarray] = draws


MEASURES = Measures()


def adjusted_rows(packed: DataFrame, keys: list[str], grouped: bool, t: Thresholds = THRESHOLDS) -> DataFrame:
    """Gathered tests with their adjusted values: ``ry`` of ``y``, and ``rx`` of ``x`` unless ``grouped``.

    Rows of ``packed`` hold (day, weekend, y) and x or inside; a weekend of 0 throughout adjusts for none. The same numbers
    as ``residuals.adjusted``, without the windows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    second = "inside int" if grouped else "x double, rx double"
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"rows array<struct<day date, weekend int, y double, ry double, {second}>>", "n int"])
    target = to_arrow_schema(StructType.fromDDL(schema))
    item = target.field("rows").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(b.schema.get_field_index("rows"))
            flat = rows.flatten()
            made = {name: np.zeros(len(flat)) for name in ("ry", "rx")}
            at = 0
            for _, own in _rows(b, ["day", "weekend", "y", *([] if grouped else ["x"])]):
                n = len(own["day"])
                for value, out in (("y", "ry"),) if grouped else (("y", "ry"), ("x", "rx")):
                    made[out][at : at + n] = detrended(own[value][None, :], own["day"], own["weekend"].astype(float), t.detrend_window)[0]
                at += n
            fields = [pa.array(made[f.name], f.type) if f.name in made else flat.field(f.name).cast(f.type) for f in item]
            offsets = pa.array(np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy())]).astype(np.int32))
            nested = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(item))).cast(target.field("rows").type)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keys], nested, b.column(b.schema.get_field_index("n"))], schema=target)

    return packed.select(*keys, "rows", "n").mapInArrow(run, schema)


def examined(packed: DataFrame, keys: list[str], grouped: bool, t: Thresholds = THRESHOLDS, m: Measures = MEASURES, null: bool = True) -> DataFrame:
    """(keys, n, effect, scaled, raw_difference, null_sd, null_method) of adjusted tests, in one pass over each.

    Without ``null`` only the effect is measured; with it, tests that have no effect or no null have no row.
    """

    def work(test: str, rows: dict[str, np.ndarray]) -> tuple:
        a, b = (rows["ry"], rows["inside"]) if grouped else (rows["rx"], rows["ry"])
        effect = (m.difference if grouped else m.correlation)(a[None, :], b[None, :])
        scaled = effect if grouped else m.transform(effect)
        value, on_scale = (float(v[0]) if np.isfinite(v[0]) else None for v in (effect, scaled))
        inside = b == 1
        raw = float(rows["y"][inside].mean() - rows["y"][~inside].mean()) if grouped and inside.any() and not inside.all() else None
        sd, method = None, None
        if null and value is not None:
            sd, method = _block_spread(test, rows, t, m.difference, m.draw) if grouped else _rotation_spread(test, rows, t, m.correlation, m.transform, m.draw)
        return len(a), value, on_scale, raw, sd, method

    out = [("n", "int"), ("effect", "double"), ("scaled", "double"), ("raw_difference", "double"), *_NULL]
    found = _mapped(packed, keys, ["day", "weekend", "y", "ry", *(["inside"] if grouped else ["x", "rx"])], out, work)
    return found.filter("null_method IS NOT NULL") if null else found
