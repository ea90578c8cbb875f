"""Distances from points to a parametric spline curve.

Few curves go to every task (behind a check of their size), and points are worked
on by numpy, many at once, with no shuffle.  Many curves, told apart by batch
columns, meet their points by a shuffle; a batch's points are dealt to several tasks
with a copy of its curve each, so that no batch has to be in one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from fieldloom.functions.bounds import place
from fieldloom.functions.splines import pieces
from fieldloom.meta import bound_of, spline_of

#: Control points of all curves together that every task may get, and of one curve that a task may get.
MAX_CONTROL_POINTS, MAX_OF_A_CURVE = 1_000_000, 1_000_000
#: Tasks that a batch's points are dealt to, if curves are many.
DEALT = 16
_GOLDEN = (1 + 5**0.5) / 2


def spline_values(d: np.ndarray, order: int, derivative: int = 0) -> np.ndarray:
    """The B-spline or a derivative at signed distances within its support."""
    a = np.abs(d)
    if order == 0:
        return np.ones_like(d) if derivative == 0 else np.zeros_like(d)
    parts = pieces(order, derivative)
    out = np.polynomial.polynomial.polyval(a, parts[-1][1])
    for end, coefficients in reversed(parts[:-1]):
        out = np.where(a < end, np.polynomial.polynomial.polyval(a, coefficients), out)
    return np.where(d < 0, -out, out) if derivative == 1 else out


class Curve:
    """Control points of shape (n, dimensions) under a spline order and a boundary condition."""

    def __init__(self, points: np.ndarray, order: int, bound):
        self.order, n = int(order), len(points)
        # places beyond the ends that any parameter within a period needs
        self.pad = n + self.order + 2
        where = [place(i, n, bound) for i in range(-self.pad, n + self.pad)]
        self.padded = np.stack([s * points[j] if s else np.zeros_like(points[0]) for j, s in where])
        self.n = n

    def at(self, t: np.ndarray, derivative: int = 0) -> np.ndarray:
        """Positions (or derivatives) at parameters ``t``; those far beyond the ends count as the padding's end."""
        t = np.clip(t, -self.pad + self.order + 1, self.n + self.pad - self.order - 2)
        low = (np.where(t >= 0, np.floor(t + 0.5), np.ceil(t - 0.5)) if self.order == 0 else np.floor(t - (self.order - 1) / 2)).astype(np.int64)
        out = 0
        for k in range(self.order + 1):
            out = out + spline_values(t - (low + k), self.order, derivative)[..., None] * self.padded[low + k + self.pad]
        return out


def _curves(coeff: DataFrame, batch: Sequence[str], k: str, p: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Control points by batch, brought to the driver; their number has been checked."""
    table = coeff.select(*batch, k, *[F.col(c).cast("double").alias(c) for c in p]).toPandas()
    groups = [((), table)] if not batch else [(key if isinstance(key, tuple) else (key,), g) for key, g in table.groupby(list(batch))]
    return {key: g.sort_values(k)[list(p)].to_numpy(float) for key, g in groups}


def _co_grouped(points: DataFrame, coeff: DataFrame, loc: Sequence[str], k: str, p: Sequence[str], order, bound, batch: Sequence[str], need: Sequence[str], step: Callable, keep: Sequence[str], schema: T.StructType) -> DataFrame:
    """``_mapped`` for curves that are too many for every task: points and curves meet by batch."""
    largest = coeff.groupBy(*batch).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if largest and largest > MAX_OF_A_CURVE:
        raise ValueError(f"a curve has {largest} control points, more than {MAX_OF_A_CURVE}")
    left = points.select(*dict.fromkeys([*keep, *need])).withColumn("_dealt", F.pmod(F.xxhash64(*loc), F.lit(DEALT)).cast("int"))
    right = coeff.select(*batch, F.col(k).alias("_k"), *[F.col(c).cast("double").alias(f"_p{i}") for i, c in enumerate(p)])
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("_dealt"))

    def run(some: pd.DataFrame, curve: pd.DataFrame) -> pd.DataFrame:
        time, dist = np.zeros(len(some)), np.full(len(some), np.inf)
        if len(curve) and len(some):
            made = Curve(curve.sort_values("_k")[[f"_p{i}" for i in range(len(p))]].to_numpy(float), order, bound)
            for a in range(0, len(some), 4096):
                part = some.iloc[a : a + 4096]
                time[a : a + 4096], dist[a : a + 4096] = step(made, part[list(loc)].to_numpy(float), part)
        out = some[list(keep)].copy()
        out["time"], out["dist"] = time, dist
        return out

    by = [*batch, "_dealt"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, schema)


def _mapped(points: DataFrame, coeff: DataFrame, loc: Sequence[str], k: str, p: Sequence[str], order, bound, batch: Sequence[str], need: Sequence[str], step: Callable) -> DataFrame:
    """Points with columns ``time`` and ``dist`` from ``step(curve, places, frame)``, curve by curve; points of a batch without a curve have time 0 and infinite distance."""
    order, bound = spline_of(order), bound_of(bound)
    if len(loc) != len(p):
        raise ValueError("points and control points have different dimensions")
    keep = [c for c in points.columns if c not in ("time", "dist")]
    schema = T.StructType([*points.select(*keep).schema.fields, T.StructField("time", T.DoubleType()), T.StructField("dist", T.DoubleType())])
    if (n := coeff.count()) > MAX_CONTROL_POINTS:
        if not batch:
            raise ValueError(f"a curve has {n} control points, more than {MAX_CONTROL_POINTS}")
        return _co_grouped(points, coeff, loc, k, p, order, bound, batch, need, step, keep, schema)
    made = {key: Curve(x, order, bound) for key, x in _curves(coeff, batch, k, p).items()}
    shared = points.sparkSession.sparkContext.broadcast(made)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            time, dist = np.zeros(len(f)), np.full(len(f), np.inf)
            rows = {(): np.arange(len(f))} if not batch else {key if isinstance(key, tuple) else (key,): i for key, i in f.groupby(list(batch)).indices.items()}
            for key, at in rows.items():
                if (curve := shared.value.get(key)) is not None:
                    part = f.iloc[at]
                    for a in range(0, len(at), 4096):
                        some = part.iloc[a : a + 4096]
                        time[at[a : a + 4096]], dist[at[a : a + 4096]] = step(curve, some[list(loc)].to_numpy(float), some)
            out = f[keep].copy()
            out["time"], out["dist"] = time, dist
            yield out

    return points.select(*dict.fromkeys([*keep, *need])).mapInPandas(run, schema)


def _squared(curve: Curve, x: np.ndarray, t: np.ndarray) -> np.ndarray:
    return ((x - curve.at(t)) ** 2).sum(-1)


def dt_spline_table(points: DataFrame, coeff: DataFrame, loc: Sequence[str], times: Sequence[float] | str, k: str = "k", p: Sequence[str] = ("p0", "p1"), order: int | str = 3, bound="dct2", batch: Sequence[str] = ()) -> DataFrame:
    """Of candidate times (for all points, or an array column) the one whose place on the curve is nearest, and the squared distance; the first of equals."""

    def step(curve: Curve, x: np.ndarray, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        time, dist = np.zeros(len(x)), np.full(len(x), np.inf)
        if isinstance(times, str):
            for i, t in enumerate(frame[times]):
                t = np.asarray(t, float)
                d = _squared(curve, x[i], t) if len(t) else np.zeros(0)
                if len(d) and np.isfinite(d).any():
                    j = int(np.nanargmin(d))
                    time[i], dist[i] = t[j], d[j]
            return time, dist
        given = np.asarray(list(times), float)
        at = curve.at(given)
        for a in range(0, len(given), 256):
            d = ((x[:, None, :] - at[None, a : a + 256]) ** 2).sum(-1)
            j = d.argmin(1)
            best = d[np.arange(len(x)), j]
            better = best < dist
            time[better], dist[better] = given[a + j[better]], best[better]
        return time, dist

    return _mapped(points, coeff, loc, k, p, order, bound, batch, [times] if isinstance(times, str) else [], step)


def dt_spline_brent(points: DataFrame, coeff: DataFrame, loc: Sequence[str], k: str = "k", p: Sequence[str] = ("p0", "p1"), order: int | str = 3, bound="dct2", batch: Sequence[str] = (), max_iter: int = 64, tol: float = 1e-6, step_size: float = 0.1) -> DataFrame:
    """``time`` and ``dist`` (columns of the points, as of the table search) refined without derivatives: a bracket by golden steps and parabolas, then Brent's search.  Never worse than the seed."""

    def step(curve: Curve, x: np.ndarray, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        seed, best = frame["time"].to_numpy(float), frame["dist"].to_numpy(float)
        f = lambda t: _squared(curve, x, t)
        a, b = seed.copy(), seed + step_size
        fa, fb = f(a), f(b)
        swap = fb > fa
        a, b, fa, fb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, fb, fa), np.where(swap, fa, fb)
        c = b + _GOLDEN * (b - a)
        fc = f(c)
        for _ in range(max_iter):
            going = fb > fc
            if not going.any():
                break
            r, q = (b - a) * (fb - fc), (b - c) * (fb - fa)
            bottom = 2 * np.where(np.abs(q - r) > 1e-20, q - r, 1e-20)
            u = b - ((b - c) * q - (b - a) * r) / bottom
            onward = c + _GOLDEN * (c - b)
            limit = b + 16 * (c - b)
            ahead = (u - c) * (limit - u) > 0
            u = np.where(ahead, u, onward)
            fu = f(u)
            a, b, c = np.where(going, b, a), np.where(going, c, b), np.where(going, u, c)
            fa, fb, fc = np.where(going, fb, fa), np.where(going, fc, fb), np.where(going, fu, fc)
        low, high = np.minimum(a, c), np.maximum(a, c)
        t, w, v = b.copy(), b.copy(), b.copy()
        ft, fw, fv = fb.copy(), fb.copy(), fb.copy()
        last = before = high - low
        for _ in range(max_iter):
            middle, tiny = 0.5 * (low + high), tol * np.abs(t) + 1e-12
            active = np.abs(t - middle) > 2 * tiny - 0.5 * (high - low)
            if not active.any():
                break
            r, q = (t - w) * (ft - fv), (t - v) * (ft - fw)
            num, den = (t - v) * q - (t - w) * r, 2 * (q - r)
            num, den = np.where(den > 0, -num, num), np.abs(den)
            good = (den > 0) & (np.abs(num) < np.abs(0.5 * den * before)) & (num > den * (low - t)) & (num < den * (high - t))
            golden = np.where(t >= middle, low - t, high - t)
            move = np.where(good, num / np.where(den > 0, den, 1), (2 - _GOLDEN) * golden)
            before = np.where(good, last, golden)
            last = move
            u = np.where(np.abs(move) >= tiny, t + move, t + np.where(move >= 0, tiny, -tiny))
            fu = f(u)
            better = (fu <= ft) & active
            worse = ~better & active
            low, high = np.where(better & (u >= t), t, low), np.where(better & (u < t), t, high)
            low, high = np.where(worse & (u < t), u, low), np.where(worse & (u >= t), u, high)
            second = worse & ((fu <= fw) | (w == t))
            third = worse & ~second & ((fu <= fv) | (v == t) | (v == w))
            v, fv = np.where(better | second, w, np.where(third, u, v)), np.where(better | second, fw, np.where(third, fu, fv))
            w, fw = np.where(better, t, np.where(second, u, w)), np.where(better, ft, np.where(second, fu, fw))
            t, ft = np.where(better, u, t), np.where(better, fu, ft)
        win = ft < best
        return np.where(win, t, seed), np.where(win, ft, best)

    return _mapped(points, coeff, loc, k, p, order, bound, batch, ["time", "dist"], step)


def dt_spline_gaussnewton(points: DataFrame, coeff: DataFrame, loc: Sequence[str], k: str = "k", p: Sequence[str] = ("p0", "p1"), order: int | str = 3, bound="dct2", batch: Sequence[str] = (), max_iter: int = 16, tol: float = 1e-6) -> DataFrame:
    """``time`` and ``dist`` refined by Gauss-Newton steps with back-tracking (up to 12 halvings, then growth by half), times within the curve; ends when a step gains less than ``tol`` of the distance."""

    def step(curve: Curve, x: np.ndarray, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        t, best = frame["time"].to_numpy(float).copy(), frame["dist"].to_numpy(float).copy()
        armijo, active = np.ones(len(t)), np.ones(len(t), bool)
        for _ in range(max_iter):
            if not active.any():
                break
            slope = curve.at(t, 1)
            down = ((curve.at(t) - x) * slope).sum(-1) / np.maximum((slope**2).sum(-1), 1e-30)
            accepted, start = np.zeros(len(t), bool), best.copy()
            for _ in range(12):
                u = np.clip(t - armijo * down, 0, curve.n - 1)
                d = _squared(curve, x, u)
                win = active & ~accepted & (d < best)
                t, best = np.where(win, u, t), np.where(win, d, best)
                accepted |= win
                armijo = np.where(active & ~accepted, armijo / 2, armijo)
                if (accepted | ~active).all():
                    break
            armijo = np.where(accepted, armijo * 1.5, armijo)
            active &= accepted & (start - best >= tol * start)
        return t, best

    return _mapped(points, coeff, loc, k, p, order, bound, batch, ["time", "dist"], step)
