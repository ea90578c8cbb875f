"""Uniform B-splines of order 0 to 7 and their derivatives as column expressions.

Polynomials come from the truncated powers: an order-k spline is
sum_j (-1)^j C(k+1, j) (x + (k+1)/2 - j)_+^k / k!.
"""

from __future__ import annotations

import functools
from fractions import Fraction
from math import comb, factorial

from pyspark.sql import Column, functions as F

from fieldloom.meta import Spline, spline_of


@functools.lru_cache(maxsize=None)
def pieces(order: int, derivative: int = 0) -> tuple[tuple[float, tuple[float, ...]], ...]:
    """(upper end, coefficients from the constant up) of the polynomials in the distance from 0, outwards."""
    half = Fraction(order + 1, 2)
    ends = [half - j for j in range(order, -1, -1) if half - j > 0]
    out, low = [], Fraction(0)
    for end in ends:
        middle, total = (low + end) / 2, [Fraction(0)] * (order + 1)
        for j in range(order + 2):
            shift = half - j
            if middle + shift > 0:
                for p in range(order + 1):
                    total[p] += Fraction((-1) ** j * comb(order + 1, j) * comb(order, p), factorial(order)) * shift ** (order - p)
        for _ in range(derivative):
            total = [p * c for p, c in enumerate(total)][1:] or [Fraction(0)]
        out.append((float(end), tuple(float(c) for c in total)))
        low = end
    return tuple(out)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def _piecewise(distance: Column, order: int, derivative: int) -> Column:
    parts = pieces(order, derivative)
    expr = None
    for end, coefficients in parts[:-1]:
        branch = _horner(distance, coefficients)
        expr = F.when(distance < end, branch) if expr is None else expr.when(distance < end, branch)
    last = _horner(distance, parts[-1][1])
    return last if expr is None else expr.otherwise(last)


def weight(d: Column, order: int | Spline) -> Column:
    """The spline at signed distance ``d`` within its support."""
    order = spline_of(order)
    return F.lit(1.0) if order == 0 else _piecewise(F.abs(d), int(order), 0)


def at_tap(d: Column, order: int | Spline, tap: int, derivative: int = 0) -> Column:
    """The spline (or a derivative) at the distance ``d`` of the ``tap``-th of order + 1 taps: which polynomial holds there is known beforehand."""
    order = int(spline_of(order))
    if order == 0:
        return F.lit(1.0 if derivative == 0 else 0.0)
    middle = (order - 1) / 2 - tap + 0.5
    coefficients = next(c for end, c in pieces(order, derivative) if abs(middle) < end)
    inner = _horner(-d if middle < 0 else d, coefficients)
    return -inner if middle < 0 and derivative == 1 else inner


def value(d: Column, order: int | Spline) -> Column:
    """The spline anywhere: 0 beyond its support; order 0 has 1 up to a half."""
    order = spline_of(order)
    half = (int(order) + 1) / 2
    return F.when(F.abs(d) <= half, weight(d, order)).otherwise(0.0)


def first_tap(x: Column, order: int | Spline, resize: bool = False) -> Column:
    """The lowest of the order + 1 voxels that weigh in at ``x``.

    The nearest voxel is found by rounding halves away from zero in sampling,
    and upwards in resizing.
    """
    order = spline_of(order)
    if order == 0:
        return (F.floor(x + 0.5) if resize else F.round(x)).cast("int")
    return F.floor(x - (int(order) - 1) / 2).cast("int")
