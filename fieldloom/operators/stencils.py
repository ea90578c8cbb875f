"""Regularisation operators on fields and flows: stencils with boundary conditions.

A stencil is a list of taps.  Fields are taken by bricks (``bricks``): a shuffle of
the field and the bricks' halos, whatever the number of taps, and numpy in them.

Weighted operators need products of several neighbours' values, so there each
voxel receives its neighbours' values as columns, from the bricks again, and the
rest is arithmetic on rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.functions import bounds
from fieldloom.meta import Bound, Field, bound_of, per_axis
from fieldloom.operators import bricks, posdef

Offset = tuple[int, ...]


@dataclass(frozen=True)
class Penalties:
    """Weights of the penalties, for each channel of a field: ``absolute``, ``membrane``, ``bending``; for flows one number each, also of ``shears`` and ``div``."""

    absolute: Sequence[float]
    membrane: Sequence[float]
    bending: Sequence[float]
    voxel: Sequence[float]
    shears: float = 0.0
    div: float = 0.0
    flow: bool = False

    @property
    def inverse_squares(self) -> list[float]:
        return [1.0 / (x * x) for x in self.voxel]

    @property
    def radius(self) -> int:
        """How far taps reach."""
        return 2 if any(self.bending) else 1 if any(self.membrane) or self.lame else 0

    @property
    def lame(self) -> bool:
        return self.flow and bool(self.shears or self.div)


def field_penalties(ndim: int, channels: int, absolute=0.0, membrane=0.0, bending=0.0, voxel_size=1.0) -> Penalties:
    return Penalties(*[per_axis(x, channels, n) for x, n in ((absolute, "absolute"), (membrane, "membrane"), (bending, "bending"))], per_axis(voxel_size, ndim, "voxel_size"))


def flow_penalties(ndim: int, absolute=0.0, membrane=0.0, bending=0.0, shears=0.0, div=0.0, voxel_size=1.0) -> Penalties:
    return Penalties(*[[float(x)] * ndim for x in (absolute, membrane, bending)], per_axis(voxel_size, ndim, "voxel_size"), float(shears), float(div), True)


def _unit(ndim: int, *steps: tuple[int, int]) -> Offset:
    out = [0] * ndim
    for axis, by in steps:
        out[axis] = by
    return tuple(out)


def same_channel(p: Penalties, c: int) -> tuple[float, dict[Offset, float]]:
    """(weight of the centre, weights by offset) that channel ``c`` reads itself with, in the form a f + sum w (f' - f)."""
    v, ndim = p.inverse_squares, len(p.voxel)
    scale = 1.0 / v[c] if p.flow else 1.0
    taps: dict[Offset, float] = {}
    total = sum(v)
    for d in range(ndim):
        w = scale * (-p.membrane[c] * v[d] - 4 * p.bending[c] * v[d] * total)
        if p.flow:
            w += -2 * p.shears - p.div if d == c else -p.shears * v[d] / v[c]
        for s in (-1, 1):
            taps[_unit(ndim, (d, s))] = w
            if p.bending[c]:
                taps[_unit(ndim, (d, 2 * s))] = scale * p.bending[c] * v[d] * v[d]
    for d, e in itertools.combinations(range(ndim), 2):
        if p.bending[c]:
            for s, t in itertools.product((-1, 1), repeat=2):
                taps[_unit(ndim, (d, s), (e, t))] = scale * 2 * p.bending[c] * v[d] * v[e]
    return scale * p.absolute[c], {o: w for o, w in taps.items() if w}


def cross_channel(p: Penalties, ndim: int) -> dict[tuple[int, int], dict[Offset, float]]:
    """Weights by offset that channel d of a flow reads channel e with."""
    if not p.lame:
        return {}
    w = (p.shears + p.div) / 4
    return {(d, e): {_unit(ndim, (d, s), (e, t)): -w * s * t for s in (-1, 1) for t in (-1, 1)} for d in range(ndim) for e in range(ndim) if d != e and w}


def apply_stencil(field: Field, p: Penalties, bound: Bound, carry: Sequence[str] = (), out: Sequence[str] | None = None) -> DataFrame:
    """L f: the keys, the result as columns ``out`` (by default the channels' names), and the ``carry`` columns (numbers) of each voxel."""
    ndim, chans = field.ndim, list(field.channels)
    out = list(out or chans)
    around = tuple([bound] * ndim)
    # by output: (channel read, offset, bounds, weight)
    reads: list[list[tuple[str, Offset, tuple[Bound, ...], float]]] = []
    for c, name in enumerate(chans):
        centre, taps = same_channel(p, c)
        reads.append([(name, _unit(ndim), around, centre - sum(taps.values())), *[(name, o, around, w) for o, w in taps.items()]])
    for (d, e), taps in cross_channel(p, ndim).items():
        crossed = tuple(bounds.transposed(bound) if k == d else bound for k in range(ndim))
        reads[d] += [(chans[e], o, crossed, w) for o, w in taps.items()]

    def made(brick: bricks.Brick) -> dict[str, np.ndarray]:
        results = {}
        for name, taps in zip(out, reads):
            total = 0.0
            for column, o, bound_, w in taps:
                value, sign = brick.read(column, o, bound_)
                total = total + w * (value if (sign == 1).all() else np.where(sign, sign * value, 0.0))
            results[name] = total
        return results

    inner = [f"_o{k}" for k in range(len(out))]
    table = bricks.mapped(field.df, field.batch, field.axes, p.radius, bound, chans, list(carry), inner, lambda b: dict(zip(inner, made(b).values())), field.gaps)
    return table.select(*field.keys, *[F.col(i).alias(n) for n, i in zip(out, inner)], *carry)


def neighbourhood(df: DataFrame, batch: Sequence[str], axes: Mapping[str, int], radius: int, bound: Bound, reads: Mapping[str, tuple[str, Offset, Sequence[Bound], bool]], carry: Sequence[str], gaps: bool = False) -> DataFrame:
    """Each voxel with neighbours' values: ``reads`` maps a new column to (column, offset, bounds, whether the boundary's sign applies); null where there is no neighbour."""
    columns = list(dict.fromkeys(c for c, *_ in reads.values()))

    def made(brick: bricks.Brick) -> dict[str, np.ndarray]:
        results = {}
        for name, (column, o, around, signed) in reads.items():
            value, sign = brick.read(column, o, tuple(around))
            results[name] = np.ma.masked_array(sign * value if signed else value, np.broadcast_to(sign == 0, value.shape))
        return results

    return bricks.mapped(df, batch, axes, radius, bound, columns, carry, list(reads), made, gaps)


# --- unweighted operators -------------------------------------------------


def _op(field: Field, result: DataFrame, channels: Sequence[str]) -> Field:
    return Field(result, field.axes, channels, field.batch, field.gaps)


def _check(field: Field, p: Penalties) -> None:
    if p.flow and len(field.channels) != field.ndim:
        raise ValueError("a flow has a channel for each axis")


def matvec(field: Field, p: Penalties, bound="dct2") -> Field:
    """L f."""
    _check(field, p)
    return _op(field, apply_stencil(field, p, bound_of(bound)), field.channels)


def addmatvec_(acc: Sequence[str], field: Field, p: Penalties, bound="dct2", sign: int = 1) -> Field:
    """acc + L f (acc - L f with ``sign`` -1), for columns ``acc`` of the field's table; the field's own channels go."""
    _check(field, p)
    moved = apply_stencil(field, p, bound_of(bound), carry=acc, out=[f"_r{c}" for c in range(len(field.channels))])
    return _op(field, moved.select(*field.keys, *[(F.col(a) + sign * F.col(f"_r{k}")).alias(a) for k, a in enumerate(acc)]), acc)


def submatvec_(acc: Sequence[str], field: Field, p: Penalties, bound="dct2") -> Field:
    """acc - L f."""
    return addmatvec_(acc, field, p, bound, -1)


def _sign(a: str, n: int, o: int, bound: Bound) -> Column:
    return bounds.index_and_sign(F.col(a) + o, n, bound)[1] if o else F.lit(1)


def diagonal(axes: Mapping[str, int], p: Penalties, bound: Bound, c: int) -> Column:
    """The operator's diagonal for channel ``c`` from coordinates alone: a - sum of weights times signs."""
    centre, taps = same_channel(p, c)
    out = F.lit(centre)
    for o, w in taps.items():
        sign = None
        for (a, n), step in zip(axes.items(), o):
            if step:
                s = _sign(a, n, step, bound)
                sign = s if sign is None else sign * s
        out = out - F.lit(w) * sign
    return out


def diag(field: Field, p: Penalties, bound="dct2") -> Field:
    """The operator's diagonal as a field."""
    _check(field, p)
    b = bound_of(bound)
    return _op(field, field.df.select(*field.keys, *[diagonal(field.axes, p, b, k).alias(c) for k, c in enumerate(field.channels)]), field.channels)


def adddiag_(field: Field, p: Penalties, bound="dct2", sign: int = 1) -> Field:
    """The field's values plus (minus, with ``sign`` -1) the diagonal."""
    _check(field, p)
    b = bound_of(bound)
    return _op(field, field.df.select(*field.keys, *[(v + sign * diagonal(field.axes, p, b, k)).alias(c) for k, (c, v) in enumerate(zip(field.channels, field.values()))]), field.channels)


def subdiag_(field: Field, p: Penalties, bound="dct2") -> Field:
    return adddiag_(field, p, bound, -1)


def kernel_table(p: Penalties, ndim: int, channels: int) -> dict[Offset, dict[str, float]]:
    """The stencil by offset: ``k<c>`` of each channel; with cross terms ``k<out><in>``."""
    out: dict[Offset, dict[str, float]] = {o: {} for o in itertools.product(range(-p.radius, p.radius + 1), repeat=ndim)}
    name = (lambda d, e: f"k{d}{e}") if p.lame else (lambda d, e: f"k{d}")
    for c in range(channels):
        centre, taps = same_channel(p, c)
        out[_unit(ndim)][name(c, c)] = centre - sum(taps.values())
        for o, w in taps.items():
            out[o][name(c, c)] = w
    for (d, e), taps in cross_channel(p, ndim).items():
        for o, w in taps.items():
            out[o][name(d, e)] = out[o].get(name(d, e), 0.0) + w
    return out


def kernel(spark, p: Penalties, axes: Mapping[str, int], channels: int | None = None) -> Field:
    """The stencil on a grid of the given sizes, centred at voxel (n - 1) // 2, 0 elsewhere; taps beyond the grid are left out."""
    from fieldloom.meta import dense

    ndim, channels = len(axes), channels or (len(axes) if p.flow else len(p.absolute))
    names = [f"k{d}{e}" for d in range(ndim) for e in range(ndim)] if p.lame else [f"k{c}" for c in range(channels)]
    rows = []
    for o, values in kernel_table(p, ndim, channels).items():
        at = [(n - 1) // 2 + s for n, s in zip(axes.values(), o)]
        if values and all(0 <= x < n for x, n in zip(at, axes.values())):
            rows.append((*at, *[float(values.get(n, 0.0)) for n in names]))
    table = spark.createDataFrame(rows, ", ".join([f"{a} int" for a in axes] + [f"_{n} double" for n in names]))
    full = dense(None, axes, spark).join(F.broadcast(table), list(axes), "left")  # the stencil has at most 125 entries
    return Field(full.select(*axes, *[F.coalesce(f"_{n}", F.lit(0.0)).alias(n) for n in names]), axes, names)


def addkernel_(field: Field, p: Penalties, sign: int = 1) -> Field:
    """The field's values plus (minus) the stencil, for fields with the kernel's channels."""
    n_channels = len(p.absolute)
    made = kernel(field.df.sparkSession, p, field.axes, n_channels)
    if len(made.channels) != len(field.channels):
        raise ValueError(f"the stencil has {len(made.channels)} channels")
    renamed = made.df.toDF(*field.axes, *[f"_k{i}" for i in range(len(made.channels))]).where(" or ".join(f"_k{i} <> 0" for i in range(len(made.channels))))
    joined = field.df.join(F.broadcast(renamed), list(field.axes), "left")
    return _op(field, joined.select(*field.keys, *[(v + sign * F.coalesce(f"_k{i}", F.lit(0.0))).alias(c) for i, (c, v) in enumerate(zip(field.channels, field.values()))]), field.channels)


def subkernel_(field: Field, p: Penalties) -> Field:
    return addkernel_(field, p, -1)


def hessian_columns(h: Sequence[str] | None, channels: int) -> list[Column]:
    """Packed columns of a matrix field; no names: zeros."""
    if h is None:
        return [F.lit(0.0)] * posdef.packed_size(channels)
    posdef.require_packed(h, channels)
    return [F.col(x).cast("double") for x in h]


def forward(field: Field, p: Penalties, hessian: Sequence[str] | None, bound="dct2") -> Field:
    """(H + L) f, for packed columns ``hessian`` of the field's table."""
    _check(field, p)
    n = len(field.channels)
    if hessian is not None:
        posdef.require_packed(hessian, n)
    carry = [*field.channels, *(hessian or ())]
    moved = apply_stencil(field, p, bound_of(bound), carry=carry, out=[f"_r{k}" for k in range(n)])
    hv = posdef.products(hessian_columns(hessian, n), field.values())
    return _op(field, moved.select(*field.keys, *[(F.col(f"_r{k}") + x).alias(c) for k, (c, x) in enumerate(zip(field.channels, hv))]), field.channels)


def precond(field: Field, p: Penalties, hessian: Sequence[str] | None, bound="dct2", out: Sequence[str] | None = None) -> Field:
    """(H + diag L) \\ f; other columns of the table stay."""
    _check(field, p)
    n, b = len(field.channels), bound_of(bound)
    h = hessian_columns(hessian, n)
    full = [h[k] + diagonal(field.axes, p, b, k) for k in range(n)] + h[n:]
    out = list(out or field.channels)
    return _op(field, posdef.solve_columns(field.df, full, field.values(), out), out)


def precond_(field: Field, p: Penalties, hessian: Sequence[str] | None, bound="dct2") -> Field:
    """(H + diag L) \\ f in place of f."""
    return precond(field, p, hessian, bound)


# --- weighted operators ---------------------------------------------------


def _weight_of(weights: Sequence[str], c: int) -> str:
    return weights[c] if len(weights) > 1 else weights[0]


def _check_weights(field: Field, p: Penalties, weights: Sequence[str]) -> None:
    _check(field, p)
    if len(weights) not in (1, len(field.channels)):
        raise ValueError("one weight for all channels, or one for each")
    if p.flow and (len(weights) != 1 or any(p.bending)):
        raise ValueError("flows have one weight for all channels, and no bending penalty with it")


def _named(prefix: str, o: Offset) -> str:
    return f"_{prefix}_" + "_".join(str(s).replace("-", "m") for s in o)


class _Weighted:
    """Columns of a voxel's neighbourhood, from which the weighted operator and its diagonal are put together."""

    def __init__(self, field: Field, p: Penalties, weights: Sequence[str], bound: Bound):
        self.field, self.p, self.weights, self.bound = field, p, list(weights), bound
        self.ndim = field.ndim
        self.taps = sorted({o for c in range(len(field.channels)) for o in same_channel(p, c)[1]})
        self.cross = cross_channel(p, self.ndim)

    def gathered(self, values: bool, carry: Sequence[str] = ()) -> DataFrame:
        reads: dict[str, tuple[str, Offset, Sequence[Bound], bool]] = {}
        plain = [self.bound] * self.ndim
        for o in self.taps:
            for w in self.weights:
                reads[_named(w, o)] = (w, o, plain, False)
            if values:
                for c in self.field.channels:
                    reads[_named(c, o)] = (c, o, plain, True)
        if values:
            for (d, e), taps in self.cross.items():
                around = [bounds.transposed(self.bound) if k == d else self.bound for k in range(self.ndim)]
                for o in taps:
                    reads[_named(f"x{d}{e}", o)] = (self.field.channels[e], o, around, True)
        own = list(dict.fromkeys([*self.weights, *(self.field.channels if values else ()), *carry]))
        return neighbourhood(self.field.df, self.field.batch, self.field.axes, self.p.radius, self.bound, reads, own, self.field.gaps)

    def weight(self, w: str, o: Offset) -> Column:
        """A neighbour's weight; where there is none, the nearest one's along that direction."""
        if not any(o):
            return F.col(w)
        if sum(map(abs, o)) == 1 or o not in self.taps:
            return F.coalesce(F.col(_named(w, o)), F.col(w)) if o in self.taps else F.col(w)
        steps = [(k, s) for k, s in enumerate(o) if s]
        if len(steps) == 1:
            k, s = steps[0]
            return F.coalesce(F.col(_named(w, o)), self.weight(w, _unit(self.ndim, (k, s // 2))))
        first, second = (_unit(self.ndim, step) for step in steps)
        near = F.when(F.col(_named(w, first)).isNotNull(), self.weight(w, first)).otherwise(self.weight(w, second))
        return F.coalesce(F.col(_named(w, o)), near)

    def coefficients(self, c: int) -> tuple[Column, dict[Offset, Column]]:
        """(centre, weights by offset), as in ``same_channel`` but for the weight map folded in."""
        p, w = self.p, _weight_of(self.weights, c)
        at = lambda o: self.weight(w, o)
        here = _unit(self.ndim)
        centre, taps = same_channel(p, c)
        if not p.bending[c]:
            return F.lit(centre) * at(here), {o: F.lit(k / 2) * (at(here) + at(o)) for o, k in taps.items()}
        v = p.inverse_squares
        out: dict[Offset, Column] = {}
        for d in range(self.ndim):
            first = -p.bending[c] * v[d] * sum(v) - 0.5 * p.membrane[c] * v[d]
            second = 0.25 * p.bending[c] * v[d] * v[d]
            for s in (-1, 1):
                one, two, back, back2 = (_unit(self.ndim, (d, k * s)) for k in (1, 2, -1, -2))
                total = F.lit(first - 2 * second) * (at(here) + at(one)) - F.lit(2 * second) * (at(back) + at(two))
                for e in range(self.ndim):
                    if e != d:
                        mixed = 0.5 * p.bending[c] * v[d] * v[e]
                        sides = [at(_unit(self.ndim, (e, t))) + at(_unit(self.ndim, (d, s), (e, t))) for t in (-1, 1)]
                        total = total - F.lit(mixed) * (sides[0] + sides[1])
                out[one] = total
                out[two] = F.lit(second) * (2 * at(one) + at(two) + at(here))
        for d, e in itertools.combinations(range(self.ndim), 2):
            mixed = 0.5 * p.bending[c] * v[d] * v[e]
            for s, t in itertools.product((-1, 1), repeat=2):
                both = _unit(self.ndim, (d, s), (e, t))
                out[both] = F.lit(mixed) * (at(here) + at(_unit(self.ndim, (d, s))) + at(_unit(self.ndim, (e, t))) + at(both))
        return F.lit(centre), out  # with bending, the absolute penalty isn't weighted

    def product(self, c: int) -> Column:
        """Component ``c`` of L f."""
        own = F.col(self.field.channels[c])
        centre, taps = self.coefficients(c)
        out = centre * own
        for o, k in taps.items():
            out = out + k * (F.coalesce(F.col(_named(self.field.channels[c], o)), F.lit(0.0)) - own)
        w = self.weights[0]
        for (d, e), taps in self.cross.items():
            if d == c:
                for o in taps:
                    s, t = o[d], o[e]
                    k = F.lit(-s * t / 4) * (F.lit(self.p.shears) * self.weight(w, _unit(self.ndim, (d, s))) + F.lit(self.p.div) * self.weight(w, _unit(self.ndim, (e, t))))
                    out = out + k * F.coalesce(F.col(_named(f"x{d}{e}", o)), F.lit(0.0))
        return out

    def diagonal(self, c: int) -> Column:
        centre, taps = self.coefficients(c)
        out = centre
        for o, k in taps.items():
            sign = None
            for (a, n), step in zip(self.field.axes.items(), o):
                if step:
                    s = _sign(a, n, step, self.bound)
                    sign = s if sign is None else sign * s
            if self.field.gaps and o in self.taps:
                sign = F.when(F.col(_named(_weight_of(self.weights, c), o)).isNull(), 0).otherwise(sign)
            out = out - k * sign
        return out


def matvec_rls(field: Field, p: Penalties, weights: Sequence[str], bound="dct2") -> Field:
    """L f with a weight map: one weight column for all channels, or one for each."""
    _check_weights(field, p, weights)
    op = _Weighted(field, p, weights, bound_of(bound))
    return _op(field, op.gathered(True).select(*field.keys, *[op.product(k).alias(c) for k, c in enumerate(field.channels)]), field.channels)


def diag_rls(field: Field, p: Penalties, weights: Sequence[str], bound="dct2") -> Field:
    """The weighted operator's diagonal."""
    _check_weights(field, p, weights)
    op = _Weighted(field, p, weights, bound_of(bound))
    return _op(field, op.gathered(False).select(*field.keys, *[op.diagonal(k).alias(c) for k, c in enumerate(field.channels)]), field.channels)
