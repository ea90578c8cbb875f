"""Sampling fields at coordinates and splatting values back: gather joins and scatter aggregations.

Each point is exploded over its (order + 1) taps an axis, axis by axis, with the
boundary condition already applied.  A gather joins the taps to the voxels and
sums by point; a scatter sums by voxel.  Taps with sign 0 are dropped before any
join, and points out of view have no taps: results are made dense by zero rows
that take part in the same aggregation, so that no further join is needed.  Of
these each point has one, so the aggregation also tells if two points have the
same ids, which is refused.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fieldloom import storage
from fieldloom.functions import bounds, fov, splines
from fieldloom.meta import Bound, Field, Spline, bound_of, dense, per_axis, spline_of


@dataclass(frozen=True)
class Points:
    """Points of one or more batches: ``ids`` tell points of a batch apart, ``loc`` has a coordinate column for each axis of the field.

    Operators that give a row for each point fail when run if two points of a
    batch have the same ids; ``numbered`` gives points ids.
    """

    df: DataFrame
    ids: Sequence[str]
    loc: Sequence[str]
    batch: Sequence[str] = ()

    def __post_init__(self) -> None:
        for name in ("ids", "loc", "batch"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if missing := [c for c in (*self.ids, *self.loc, *self.batch) if c not in self.df.columns]:
            raise ValueError(f"no columns {missing}")

    @property
    def keys(self) -> list[str]:
        return [*self.batch, *self.ids]

    @classmethod
    def numbered(cls, df: DataFrame, loc: Sequence[str], batch: Sequence[str] = (), number: str = "point") -> Points:
        """Points of a table without ids of its own, with a number in a new column; the table is written, so that numbers are fixed."""
        table, _ = storage.written(df.withColumn(number, F.monotonically_increasing_id()), "points")
        return cls(table, [number], loc, batch)


def _check(points: Points, batch: Sequence[str], ndim: int) -> None:
    if tuple(points.batch) != tuple(batch):
        raise ValueError("points and field have different batch columns")
    if len(points.loc) != ndim:
        raise ValueError(f"points have {len(points.loc)} coordinates for {ndim} axes")


def _axis_taps(x: Column, n: int, order: Spline, bound: Bound, resize: bool, kinds: str) -> Column:
    """An array of (index, and as asked for weight, gradient, second derivative, signs of the boundary included, and that sign); null where the sign is 0."""
    low, out = splines.first_tap(x, order, resize), []
    for t in range(int(order) + 1):
        at = low + t
        i, s = bounds.index_and_sign(at, n, bound)
        d = x - at
        out.append(F.when(s != 0, F.struct(i.cast("int").alias("i"), *[(s.cast("double") if k == "s" else s * splines.at_tap(d, order, t, "wgh".index(k))).alias(k) for k in kinds])))
    return F.array(*out)


def taps(df: DataFrame, loc: Sequence[str | Column], axes: Mapping[str, int], order: Spline, bound: Bound, extrapolate: int = 1, resize: bool = False, kinds: str = "w") -> DataFrame:
    """``df`` exploded over taps: for each axis ``_i_<axis>`` and, of "wghs" those asked for, ``_w_``, ``_g_``, ``_h_`` and ``_s_`` (the boundary's sign) of it."""
    columns = [F.col(c).cast("double") if isinstance(c, str) else c for c in loc]
    out = df.where(fov.in_view(columns, axes, extrapolate))
    for x, (axis, n) in zip(columns, axes.items()):
        out = out.withColumn("_t", F.explode(_axis_taps(x, n, order, bound, resize, kinds))).where(F.col("_t").isNotNull())
        out = out.withColumns({f"_{k}_{axis}": F.col(f"_t.{k}") for k in "i" + kinds}).drop("_t")
    return out


def _product(axes: Sequence[str], kinds: Mapping[str, str] | None = None) -> Column:
    out = None
    for a in axes:
        c = F.col(f"_{(kinds or {}).get(a, 'w')}_{a}")
        out = c if out is None else out * c
    return out


def _order(order, bound) -> tuple[Spline, Bound]:
    return spline_of(order), bound_of(bound)


def _gathered(field: Field, points: Points, order: Spline, bound: Bound, extrapolate: int, sums: Mapping[str, tuple[Column, str]], carry: Sequence[str] = (), kinds: str = "w") -> DataFrame:
    """For each point the sums of (weight x channel), 0 out of view; weights may use the ``carry`` columns of the points."""
    tapped = taps(points.df.select(*points.keys, *points.loc, *carry), points.loc, field.axes, order, bound, extrapolate, kinds=kinds)
    voxels = field.df.select(*field.batch, *[F.col(a).cast("int").alias(f"_i_{a}") for a in field.axes], *[F.col(c).cast("double").alias(f"_f_{c}") for c in field.channels])
    joined = tapped.join(voxels, [*field.batch, *[f"_i_{a}" for a in field.axes]])
    rows = joined.select(*points.keys, *carry, *[(w * F.col(f"_f_{c}")).alias(name) for name, (w, c) in sums.items()], F.lit(0).alias("_points"))
    zeros = points.df.select(*points.keys, *carry, *[F.lit(0.0).alias(name) for name in sums], F.lit(1).alias("_points"))
    # values of the points are the same in all rows of a point
    summed = rows.unionByName(zeros).groupBy(*points.keys).agg(*[F.sum(n).alias(n) for n in sums], F.sum("_points").alias("_points"))
    once = F.when(F.col("_points") > 1, F.raise_error(F.lit("two points of a batch have the same ids")).cast("boolean")).otherwise(F.lit(True))
    return summed.where(once).drop("_points")


def pull(field: Field, points: Points, order: int | str = 2, bound: int | str = "dct2", extrapolate: int = 1) -> DataFrame:
    """The spline field at each point: the points' keys and the channels; 0 out of view."""
    _check(points, field.batch, field.ndim)
    order, bound = _order(order, bound)
    w = _product(list(field.axes))
    return _gathered(field, points, order, bound, extrapolate, {c: (w, c) for c in field.channels})


def grad(field: Field, points: Points, order: int | str = 2, bound: int | str = "dct2", extrapolate: int = 1, absolute: bool = False) -> DataFrame:
    """The field's spatial gradient at each point: columns ``<channel>_<axis>``; with ``absolute``, of the taps' absolute derivative weights."""
    _check(points, field.batch, field.ndim)
    order, bound = _order(order, bound)
    axes = list(field.axes)

    def along(a: str) -> Column:
        w = _product(axes, {a: "g"})
        if not absolute:
            return w
        out = None
        for b in axes:  # the sign of the boundary stays, that of the derivative goes
            c = F.abs(F.col(f"_g_{b}")) * F.col(f"_s_{b}") if b == a else F.col(f"_w_{b}")
            out = c if out is None else out * c
        return out

    return _gathered(field, points, order, bound, extrapolate, {f"{c}_{a}": (along(a), c) for c in field.channels for a in axes}, kinds="wgs" if absolute else "wg")


def hess(field: Field, points: Points, order: int | str = 2, bound: int | str = "dct2", extrapolate: int = 1) -> DataFrame:
    """Second derivatives at each point: columns ``<channel>_<axis><axis>``, the diagonal first."""
    _check(points, field.batch, field.ndim)
    order, bound = _order(order, bound)
    axes = list(field.axes)
    pairs = [(a, a) for a in axes] + list(itertools.combinations(axes, 2))
    kinds = lambda a, b: {a: "h"} if a == b else {a: "g", b: "g"}
    return _gathered(field, points, order, bound, extrapolate, {f"{c}_{a}{b}": (_product(axes, kinds(a, b)), c) for c in field.channels for a, b in pairs}, kinds="wgh")


def _scattered(tapped: DataFrame, batch: Sequence[str], axes: Mapping[str, int], sums: Mapping[str, Column], batches: DataFrame | None) -> DataFrame:
    rows = tapped.select(*batch, *[F.col(f"_i_{a}").alias(a) for a in axes], *[v.alias(n) for n, v in sums.items()])
    zeros = dense(batches, axes, tapped.sparkSession).select(*batch, *axes, *[F.lit(0.0).alias(n) for n in sums])
    return rows.unionByName(zeros).groupBy(*batch, *axes).agg(*[F.sum(n).alias(n) for n in sums])


def _batches(df: DataFrame, batch: Sequence[str]) -> DataFrame | None:
    return df.select(*batch).distinct() if batch else None


def accumulated(fresh: Field, into: Field | None) -> Field:
    """``fresh`` added to the channels of ``into``, if there is one: rows are appended and summed."""
    if into is None:
        return fresh
    names = [*fresh.keys, *fresh.channels]
    both = fresh.df.select(*names).unionByName(into.df.select(*into.keys, *into.channels).toDF(*names))
    return fresh.with_df(both.groupBy(*fresh.keys).agg(*[F.sum(c).alias(c) for c in fresh.channels]))


def push(points: Points, channels: Sequence[str], axes: Mapping[str, int], order: int | str = 2, bound: int | str = "dct2", extrapolate: int = 1, into: Field | None = None) -> Field:
    """The adjoint of ``pull``: the points' values splatted on a dense field; out of view they are left out."""
    _check(points, points.batch, len(axes))
    order, bound = _order(order, bound)
    tapped = taps(points.df, points.loc, axes, order, bound, extrapolate)
    w = _product(list(axes))
    out = _scattered(tapped, points.batch, axes, {c: w * F.col(c).cast("double") for c in channels}, _batches(points.df, points.batch))
    return accumulated(Field(out, axes, channels, points.batch), into)


def count(points: Points, axes: Mapping[str, int], order: int | str = 2, bound: int | str = "dct2", extrapolate: int = 1, into: Field | None = None, channel: str = "n") -> Field:
    """``push`` of ones: how much the points weigh on each voxel."""
    ones = Points(points.df.withColumn(channel, F.lit(1.0)), points.ids, points.loc, points.batch)
    return push(ones, [channel], axes, order, bound, extrapolate, into)


def _contracted(field: Field, points: Points, values: Sequence[str], order: Spline, bound: Bound, extrapolate: int) -> DataFrame:
    """Sum over channels of value x gradient at each point: a column for each axis, named as the coordinates."""
    axes = list(field.axes)
    terms = {}
    for c, v in zip(field.channels, values):
        for a in axes:
            terms[f"_{c}_{a}"] = (_product(axes, {a: "g"}) * F.col(v).cast("double"), c)
    sums = _gathered(field, points, order, bound, extrapolate, terms, carry=[v for v in values], kinds="wg")
    total = lambda a: sum((F.col(f"_{c}_{a}") for c in field.channels[1:]), F.col(f"_{field.channels[0]}_{a}"))
    return sums.select(*points.keys, *[total(a).alias(l) for a, l in zip(axes, points.loc)])


def pull_backward(field: Field, points: Points, gradient: Sequence[str], order: int | str = 2, bound: int | str = "dct2", extrapolate: int = 1, into: Field | None = None) -> tuple[Field, DataFrame]:
    """Gradients of ``pull`` given those of its output (columns of the points): for the field, and for the coordinates."""
    _check(points, field.batch, field.ndim)
    if len(gradient) != len(field.channels):
        raise ValueError("one gradient for each channel")
    order_, bound_ = _order(order, bound)
    renamed = Points(points.df.select(*points.keys, *points.loc, *[F.col(g).alias(c) for g, c in zip(gradient, field.channels)]), points.ids, points.loc, points.batch)
    to_field = push(renamed, field.channels, field.axes, order, bound, extrapolate, into)
    return to_field, _contracted(field, points, gradient, order_, bound_, extrapolate)


def push_backward(gradient: Field, points: Points, channels: Sequence[str], order: int | str = 2, bound: int | str = "dct2", extrapolate: int = 1) -> tuple[DataFrame, DataFrame]:
    """Gradients of ``push`` given that of its output (a field): for the points' values, and for the coordinates."""
    order_, bound_ = _order(order, bound)
    return pull(gradient, points, order, bound, extrapolate), _contracted(gradient, points, channels, order_, bound_, extrapolate)


def count_backward(gradient: Field, points: Points, order: int | str = 2, bound: int | str = "dct2", extrapolate: int = 1) -> DataFrame:
    """The gradient of ``count`` for the coordinates."""
    if len(gradient.channels) != 1:
        raise ValueError("a count has one channel")
    ones = Points(points.df.withColumn("_one", F.lit(1.0)), points.ids, points.loc, points.batch)
    return push_backward(gradient, ones, ["_one"], order, bound, extrapolate)[1]


def grad_backward(field: Field, points: Points, gradient: Mapping[tuple[str, str], str], order: int | str = 2, bound: int | str = "dct2", extrapolate: int = 1, into: Field | None = None) -> tuple[Field, DataFrame]:
    """Gradients of ``grad`` given those of its output, as columns of the points by (channel, axis): for the field, and for the coordinates."""
    _check(points, field.batch, field.ndim)
    order_, bound_ = _order(order, bound)
    axes = list(field.axes)
    if set(gradient) != {(c, a) for c in field.channels for a in axes}:
        raise ValueError("one gradient for each channel and axis")
    tapped = taps(points.df, points.loc, field.axes, order_, bound_, extrapolate, kinds="wg")
    value = lambda c, a: F.col(gradient[c, a]).cast("double")
    total = lambda xs: sum(xs[1:], xs[0])
    spread = {c: total([_product(axes, {a: "g"}) * value(c, a) for a in axes]) for c in field.channels}
    to_field = Field(_scattered(tapped, points.batch, field.axes, spread, _batches(points.df, points.batch)), field.axes, field.channels, field.batch)
    second = lambda a, b: _product(axes, {a: "h"} if a == b else {a: "g", b: "g"})
    terms = {f"_{c}_{b}": (total([second(a, b) * value(c, a) for a in axes]), c) for c in field.channels for b in axes}
    sums = _gathered(field, points, order_, bound_, extrapolate, terms, carry=sorted(set(gradient.values())), kinds="wgh")
    to_grid = sums.select(*points.keys, *[total([F.col(f"_{c}_{b}") for c in field.channels]).alias(l) for b, l in zip(axes, points.loc)])
    return accumulated(to_field, into), to_grid


def resample(field: Field, axes: Mapping[str, int], order: int | str = 2, bound: int | str = "dct2", shift: float = 0.0, scale: float | Sequence[float] | None = None) -> Field:
    """The field on a grid of other sizes, read at scale * (voxel + shift) - shift.

    The grid is affine, so axes are resized one after the other: order + 1 taps
    an axis instead of their product.
    """
    order, bound = _order(order, bound)
    if list(axes) != list(field.axes):
        raise ValueError("the new sizes are those of the field's axes")
    factors = per_axis(scale, field.ndim, "scale") if scale is not None else [field.axes[a] / axes[a] for a in axes]
    now = field
    for (axis, n), f in zip(axes.items(), factors):
        now = _resized(now, axis, n, order, bound, shift, f)
    return now


def _resized(field: Field, axis: str, n: int, order: Spline, bound: Bound, shift: float, scale: float) -> Field:
    """One axis resized.  The matrix from old to new places along the axis is small and known beforehand: its entries are listed by old place, and each voxel explodes into the new ones that it adds to."""
    spark = field.df.sparkSession
    line = spark.range(n).select(F.col("id").cast("int").alias("_new"), (F.lit(scale) * (F.col("id") + F.lit(shift)) - F.lit(shift)).alias("_x"))
    entries = taps(line, [F.col("_x")], {"a": field.axes[axis]}, order, bound, 1, resize=True).select("_new", F.col("_i_a").alias(axis), F.col("_w_a").alias("_w"))
    return _mapped(field, axis, n, entries)


def _mapped(field: Field, axis: str, n: int, entries: DataFrame) -> Field:
    """A field put through a matrix along one axis; ``entries`` are (_new, <axis>, _w).  Rows are as many as the axis is long, times a few taps."""
    rest = [k for k in field.keys if k != axis]
    voxels = field.df.select(*rest, F.col(axis).cast("int").alias(axis), *[v.alias(c) for v, c in zip(field.values(), field.channels)])
    joined = voxels.join(entries, axis)
    rows = joined.select(*rest, F.col("_new").alias(axis), *[(F.col("_w") * F.col(c)).alias(c) for c in field.channels])
    # places that nothing adds to are 0: each line gives a zero row for each of its places, from its voxel 0
    zeros = voxels.where(F.col(axis) == 0).select(*rest, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(axis), *[F.lit(0.0).alias(c) for c in field.channels])
    out = rows.unionByName(zeros).groupBy(*rest, axis).agg(*[F.sum(c).alias(c) for c in field.channels])
    axes = {a: n if a == axis else size for a, size in field.axes.items()}
    return Field(out, axes, field.channels, field.batch)


def restriction(field: Field, axes: Mapping[str, int], order: int | str = 2, bound: int | str = "dct2", shift: float = 0.0, scale: float | Sequence[float] | None = None, into: Field | None = None) -> Field:
    """The adjoint of ``resample``, from fine to coarse; ``scale`` is fine voxels for each coarse one.

    A fine voxel x adds with weight spline((scale * (coarse + shift) - shift - x) / scale)
    to coarse places within (order + 1) / 2 of the ends, too, which the boundary folds in.
    """
    order, bound = _order(order, bound)
    if list(axes) != list(field.axes):
        raise ValueError("the new sizes are those of the field's axes")
    factors = per_axis(scale, field.ndim, "scale") if scale is not None else [field.axes[a] / axes[a] for a in axes]
    now, pad = field, (int(order) + 1) // 2
    for (axis, n), f in zip(axes.items(), factors):
        spark, reach = field.df.sparkSession, 0.5 * (int(order) + 1) * f
        coarse = spark.range(-pad, n + pad).select(F.col("id").cast("int").alias("_at"))
        i, s = bounds.index_and_sign(F.col("_at"), n, bound)
        x = F.lit(f) * (F.col("_at") + F.lit(shift)) - F.lit(shift)
        low, high = F.greatest(F.lit(0), F.ceil(x - reach)), F.least(F.lit(field.axes[axis] - 1), F.floor(x + reach))
        listed = coarse.select(i.alias("_new"), s.alias("_s"), x.alias("_x"), low.alias("_low"), high.alias("_high")).where("_s <> 0 and _low <= _high")
        entries = listed.select("_new", "_s", "_x", F.explode(F.sequence(F.col("_low").cast("int"), F.col("_high").cast("int"))).alias(axis))
        entries = entries.select("_new", axis, (F.col("_s") * splines.value((F.col("_x") - F.col(axis)) / F.lit(f), order)).alias("_w"))
        now = _mapped(now, axis, n, entries)
    return accumulated(now, into)
