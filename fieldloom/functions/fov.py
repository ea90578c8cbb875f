"""The test whether a coordinate is within the field of view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

#: Fixed value: how far beyond the limits a coordinate still counts as within.
TOLERANCE = 0.05


def in_view(locations: Sequence[Column], axes: Mapping[str, int], extrapolate: int) -> Column:
    """``extrapolate`` 1: anywhere; 0: between the outer voxels' centres; -1: between their outer edges."""
    if extrapolate not in (-1, 0, 1):
        raise ValueError("extrapolate is -1, 0 or 1")
    out = F.lit(True)
    if extrapolate == 1:
        return out
    edge = TOLERANCE + (0.5 if extrapolate == -1 else 0.0)
    for x, n in zip(locations, axes.values()):
        out = out & (x >= -edge) & (x <= n - 1 + edge)
    return out
