"""Operators along one axis: distance transforms and the spline prefilter.

The L1 transform is two running minima.  The other two are recurrences or
envelopes over a whole line, so each line is gathered into one row of arrays and
worked on by numpy, many lines side by side; lines are the units of parallelism.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F, types as T

from fieldloom.meta import Bound, Field, bound_of, spline_of

#: Lines of up to so many voxels are transformed by all pairs, longer ones by their lower envelope.
PAIRWISE = 2048


def _axis(field: Field, axis: str | None) -> str:
    axis = axis or list(field.axes)[-1]
    if axis not in field.axes:
        raise ValueError(f"no axis {axis}")
    return axis


def dt_l1(field: Field, axis: str | None = None, spacing: float = 1.0) -> Field:
    """Along an axis (the last one by default): min over p of f(p) + spacing * |q - p|."""
    axis = _axis(field, axis)
    lines = Window.partitionBy(*[k for k in field.keys if k != axis]).orderBy(axis)
    before, after = lines.rowsBetween(Window.unboundedPreceding, 0), lines.rowsBetween(0, Window.unboundedFollowing)
    at = F.lit(float(spacing)) * F.col(axis)
    out = [F.least(at + F.min(v - at).over(before), F.min(v + at).over(after) - at).alias(c) for v, c in zip(field.values(), field.channels)]
    return field.with_df(field.df.select(*field.keys, *out))


def _by_line(field: Field, axis: str, run: Callable[[np.ndarray], np.ndarray]) -> Field:
    """``run`` maps (lines, size) values to such; lines come in any number."""
    rest = [k for k in field.keys if k != axis]
    packed = field.df.select(*rest, F.struct(F.col(axis).cast("int").alias("_x"), *[v.alias(c) for v, c in zip(field.values(), field.channels)]).alias("_v"))
    packed = packed.groupBy(*rest).agg(F.sort_array(F.collect_list("_v")).alias("_v")) if rest else packed.agg(F.sort_array(F.collect_list("_v")).alias("_v"))
    packed = packed.select(*rest, *[F.col("_v")[c].alias(c) for c in field.channels]).where(F.size(field.channels[0]) > 0)
    schema = T.StructType([*packed.select(*rest).schema.fields, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in field.channels]])

    channels = field.channels

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c in channels:
                if len(f):
                    f[c] = list(run(np.array(f[c].tolist(), np.float64)))
            yield f

    out = packed.mapInPandas(lines, schema)
    zipped = out.select(*rest, F.posexplode(F.arrays_zip(*field.channels)).alias("_x", "_v"))
    return field.with_df(zipped.select(*rest, F.col("_x").alias(axis), *[F.col("_v")[c].alias(c) for c in field.channels]).select(*field.keys, *field.channels))


def _envelope(f: np.ndarray, w2: float) -> np.ndarray:
    """min over p of f(p) + w2 (q - p)^2 for one line, by the lower envelope of its finite parabolas."""
    places = np.flatnonzero(np.isfinite(f)).tolist()
    if not places:
        return np.full(len(f), np.inf)
    hull, cuts = [places[0]], [-math.inf]
    for q in places[1:]:
        while True:
            p = hull[-1]
            s = ((f[q] + w2 * q * q) - (f[p] + w2 * p * p)) / (2 * w2 * (q - p))
            if s > cuts[-1]:
                break
            hull.pop()
            cuts.pop()
        hull.append(q)
        cuts.append(s)
    at = np.arange(len(f))
    nearest = np.array(hull)[np.searchsorted(np.array(cuts[1:]), at, side="left")]
    return f[nearest] + w2 * (at - nearest) ** 2


def squared_distances(lines: np.ndarray, spacing: float) -> np.ndarray:
    n, w2 = lines.shape[1], spacing * spacing
    if n > PAIRWISE:
        return np.stack([_envelope(f, w2) for f in lines])
    at = np.arange(n)
    cost = w2 * (at[:, None] - at[None, :]) ** 2.0
    step = max(1, 4_000_000 // (n * n))
    return np.concatenate([(lines[i : i + step, None, :] + cost[None]).min(2) for i in range(0, len(lines), step)])


def dt_euclidean(field: Field, axis: str | None = None, spacing: float = 1.0) -> Field:
    """Along an axis (the last one by default): min over p of f(p) + (spacing * (q - p))^2; a line without a finite value stays infinite."""
    if spacing <= 0:
        raise ValueError("spacing is positive")
    return _by_line(field, _axis(field, axis), lambda lines: squared_distances(lines, float(spacing)))


def poles(order: int) -> list[float]:
    """The poles within the unit circle of the inverse B-spline filter: roots of its sampled polynomial."""
    from fieldloom.functions.splines import pieces

    if order < 2:
        return []

    def sample(x: int) -> float:
        for end, coefficients in pieces(order):
            if abs(x) < end:
                return sum(c * abs(x) ** k for k, c in enumerate(coefficients))
        return 0.0

    half = order // 2
    roots = np.roots([sample(x) for x in range(-half, half + 1)])
    out = sorted((float(r.real) for r in roots if abs(r) < 1), reverse=True)
    # polish each: the roots of a palindromic polynomial come in pairs r, 1/r
    values = [sample(x) for x in range(-half, half + 1)]
    for i, r in enumerate(out):
        for _ in range(4):
            r -= np.polyval(values, r) / np.polyval(np.polyder(values), r)
        out[i] = float(r)
    return out


def _extended(kind: Bound, n: int) -> tuple[np.ndarray, int]:
    """One period of a line's places under a boundary condition."""
    at = np.arange(n)
    if kind is Bound.DFT:
        return at, n
    if kind is Bound.DCT1:
        return np.concatenate([at, at[-2:0:-1]]), max(2 * n - 2, 1)
    return np.concatenate([at, at[::-1]]), 2 * n


def prefiltered(lines: np.ndarray, order: int, bound: Bound) -> np.ndarray:
    """Spline coefficients of (lines, size) samples: for each pole a causal and an anticausal recursion over the line.

    The recursions begin with the exact sums over the periodic extension.
    """
    n = lines.shape[1]
    if n == 1 or order < 2:
        return lines.copy()
    out = lines.copy()
    for z in poles(order):
        out *= (1 - z) * (1 - 1 / z)
        places, period = _extended(bound, n)
        # the causal sum at place 0: samples at 0, -1, -2, ... of the extension, by powers of the pole
        powers = z ** np.arange(period)
        back = places[(-np.arange(period)) % period]
        causal = np.empty_like(out)
        causal[:, 0] = out[:, back] @ powers / (1 - z**period)
        for i in range(1, n):
            causal[:, i] = out[:, i] + z * causal[:, i - 1]
        if bound is Bound.DFT:
            last = causal[:, (n - 1 + np.arange(n)) % n] @ (z ** np.arange(n)) * (-z) / (1 - z**n)
        elif bound is Bound.DCT1:
            last = (causal[:, n - 1] + z * causal[:, n - 2]) * z / (z * z - 1)
        else:
            last = causal[:, n - 1] * z / (z - 1)
        out[:, n - 1] = last
        for i in range(n - 2, -1, -1):
            out[:, i] = z * (out[:, i + 1] - causal[:, i])
    return out


def spline_coeff(field: Field, order: int | str = 3, bound: int | str = "dct2", axis: str | None = None) -> Field:
    """Coefficients along an axis (the last one by default) whose spline goes through the samples; orders 0 and 1 change nothing."""
    order, bound = spline_of(order), bound_of(bound)
    if bound not in (Bound.DCT1, Bound.DCT2, Bound.DFT, Bound.REPLICATE):
        raise ValueError("prefilters have the boundary conditions dct1, dct2, dft and replicate")
    axis = _axis(field, axis)
    if order < 2:
        return field.with_df(field.df.select(*field.keys, *[v.alias(c) for v, c in zip(field.values(), field.channels)]))
    return _by_line(field, axis, lambda lines: prefiltered(lines, int(order), bound))
