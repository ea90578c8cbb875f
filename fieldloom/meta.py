"""Fields as tables: one row for each voxel, coordinates and channels as columns."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from enum import IntEnum

from pyspark.sql import Column, DataFrame, functions as F, types as T


class Bound(IntEnum):
    """How a field goes on beyond its ends."""

    DYNAMIC = -1
    ZERO = 0
    REPLICATE = 1
    DCT1 = 2
    DCT2 = 3
    DST1 = 4
    DST2 = 5
    DFT = 6
    NOCHECK = 7


class Spline(IntEnum):
    """B-spline orders."""

    NEAREST = 0
    LINEAR = 1
    QUADRATIC = 2
    CUBIC = 3
    FOURTH = 4
    FIFTH = 5
    SIXTH = 6
    SEVENTH = 7


def bound_of(value: int | str | Bound) -> Bound:
    """A boundary condition by code or name; the undetermined one isn't accepted."""
    try:
        out = Bound[value.upper()] if isinstance(value, str) else Bound(value)
    except (KeyError, ValueError):
        raise ValueError(f"no boundary condition {value!r}") from None
    if out is Bound.DYNAMIC:
        raise ValueError("the boundary condition must be a given one")
    return out


def spline_of(value: int | str | Spline) -> Spline:
    try:
        return Spline[value.upper()] if isinstance(value, str) else Spline(value)
    except (KeyError, ValueError):
        raise ValueError(f"no spline order {value!r}: orders are 0 to 7") from None


@dataclass(frozen=True)
class Field:
    """A dense field.

    ``df`` has a row for each voxel of each batch.  ``axes`` maps coordinate
    columns (whole numbers from 0) to sizes, ``channels`` names the value
    columns, ``batch`` the columns that tell fields apart.  Other columns are
    not part of the field.  Values are never null; infinity is a value.

    With ``gaps``, a batch may lack voxels.  Stencils read nothing there, as they
    do beyond the ends of a line with the zero condition, and give no row.
    """

    df: DataFrame
    axes: Mapping[str, int]
    channels: Sequence[str] = ("v",)
    batch: Sequence[str] = ()
    gaps: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "axes", dict(self.axes))
        object.__setattr__(self, "channels", tuple(self.channels))
        object.__setattr__(self, "batch", tuple(self.batch))
        if not 1 <= len(self.axes) <= 3:
            raise ValueError("fields have 1 to 3 axes")
        if any(int(n) < 1 for n in self.axes.values()):
            raise ValueError("axes have a voxel at least")
        names = [*self.axes, *self.channels, *self.batch]
        if len(set(names)) < len(names):
            raise ValueError("axes, channels and batch are different columns")
        kinds = {f.name: f.dataType for f in self.df.schema.fields}
        if missing := [c for c in names if c not in kinds]:
            raise ValueError(f"no columns {missing}")
        if odd := [c for c in self.channels if not isinstance(kinds[c], (T.DoubleType, T.FloatType))]:
            raise ValueError(f"channels {odd} aren't double or float")
        if odd := [c for c in self.axes if not isinstance(kinds[c], T.IntegralType)]:
            raise ValueError(f"coordinates {odd} aren't whole numbers")

    @property
    def ndim(self) -> int:
        return len(self.axes)

    @property
    def voxels(self) -> int:
        return functools.reduce(operator.mul, self.axes.values(), 1)

    @property
    def keys(self) -> list[str]:
        return [*self.batch, *self.axes]

    def values(self) -> list[Column]:
        return [F.col(c).cast("double") for c in self.channels]

    def with_df(self, df: DataFrame, channels: Sequence[str] | None = None) -> Field:
        return replace(self, df=df, channels=self.channels if channels is None else tuple(channels))


def require_same_batch(*fields: Field) -> None:
    if len({f.batch for f in fields}) > 1:
        raise ValueError("batch columns differ; they are not broadcast")


def require_same_grid(*fields: Field) -> None:
    require_same_batch(*fields)
    if len({tuple(f.axes.items()) for f in fields}) > 1:
        raise ValueError("axes or sizes differ")


def per_axis(value: float | Sequence[float], ndim: int, name: str) -> list[float]:
    """One number for each axis."""
    out = [float(value)] * ndim if isinstance(value, (int, float)) else [float(x) for x in value]
    if len(out) != ndim:
        raise ValueError(f"{name} has {len(out)} values for {ndim} axes")
    return out


def dense(batches: DataFrame | None, axes: Mapping[str, int], spark) -> DataFrame:
    """All voxels of the given axes, for each row of ``batches`` (once without batches); nothing is shuffled."""
    total = functools.reduce(operator.mul, axes.values(), 1)
    cells, step, columns = F.col("_cell"), total, []
    for name, n in axes.items():
        step //= n
        columns.append((F.floor(cells / step) % n).cast("int").alias(name) if step > 1 else (cells % n).cast("int").alias(name))
    if batches is None:
        return spark.range(total).withColumnRenamed("id", "_cell").select(*columns)
    return batches.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long"))).alias("_cell")).select(*batches.columns, *columns)
