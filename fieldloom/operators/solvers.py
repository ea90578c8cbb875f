"""Relaxation and conjugate gradients: driver loops over the stencil operators.

Each sweep or step reads the table once and shuffles it once; unknowns, right
hand sides and matrices are columns of one table, so that no step has a join.
Lineage is cut every few steps by a table in the shared folder; the last one
stays for the result to be read from.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fieldloom import storage
from fieldloom.meta import Field, bound_of
from fieldloom.operators import posdef, stencils
from fieldloom.operators.stencils import Penalties

#: Steps between checkpoints.
CHECKPOINT_EVERY = 4


class Cuts:
    """Cuts of lineage: each is a written table, and the one before it is removed."""

    def __init__(self) -> None:
        self.path: str | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        table, path = storage.written(df, "steps")
        if self.path:
            storage.remove(df.sparkSession, self.path)
        self.path = path
        return table


def colours(p: Penalties, ndim: int) -> tuple[int, str]:
    """How many colours a sweep has, and their kind: parity of the sum, or coordinates modulo 2 or 3."""
    if p.flow and p.lame:
        return (3**ndim, "3") if any(p.bending) else (2**ndim, "2")
    if any(p.bending):
        return 3**ndim, "3"
    return 2, "sum"


def colour_is(axes: Sequence[str], kind: str, n: int) -> Column:
    if kind == "sum":
        total = F.lit(0)
        for a in axes:
            total = total + F.col(a)
        return total % 2 == n % 2
    base, total, step = int(kind), F.lit(0), 1
    for a in axes:
        total, step = total + (F.col(a) % base) * step, step * base
    return total == n % step


def _updated(df: DataFrame, field: Field, moved: Sequence[Column], diagonal: Sequence[Column], right: Sequence[str], hessian: Sequence[str] | None, where: Column | None) -> DataFrame:
    """x + (H + D) \\ (g - L x - H x) where ``where`` holds."""
    n, x = len(field.channels), field.values()
    h = stencils.hessian_columns(hessian, n)
    hx = posdef.products(h, x)
    rest = [F.col(g).cast("double") - m - y for g, m, y in zip(right, moved, hx)]
    full = [a + d for a, d in zip(h, diagonal)] + h[n:]
    steps = [f"_s{k}" for k in range(n)]
    df = posdef.solve_columns(df, full, rest, steps)
    new = {c: v + F.col(s) for c, v, s in zip(field.channels, x, steps)}
    if where is not None:
        new = {c: F.when(where, e).otherwise(F.col(c)) for c, e in new.items()}
    return df.withColumns(new).drop(*steps)


def relax(field: Field, p: Penalties, right: Sequence[str], hessian: Sequence[str] | None = None, bound="dct2", iterations: int = 1) -> Field:
    """Coloured Gauss-Seidel sweeps for (H + L) x = g: x are the field's channels, ``right`` and packed ``hessian`` columns of its table.

    The voxels of one colour are updated together, one colour after the other.
    """
    stencils._check(field, p)
    if len(right) != len(field.channels):
        raise ValueError("a right hand side for each channel")
    b, (count, kind) = bound_of(bound), colours(p, field.ndim)
    carry = list(dict.fromkeys([*field.channels, *right, *(hessian or ())]))
    now = field.with_df(field.df.select(*field.keys, *[F.col(c).cast("double").alias(c) for c in carry]))
    n, cut = len(field.channels), Cuts()
    diagonal = [stencils.diagonal(field.axes, p, b, k) for k in range(n)]
    for step in range(iterations * count):
        chosen = colour_is(list(field.axes), kind, step)
        moved = stencils.apply_stencil(now, p, b, carry=carry, out=[f"_m{k}" for k in range(n)])
        table = _updated(moved, now, [F.col(f"_m{k}") for k in range(n)], diagonal, right, hessian, chosen).drop(*[f"_m{k}" for k in range(n)])
        now = now.with_df(cut(table) if (step + 1) % CHECKPOINT_EVERY == 0 else table)
    return now


def relax_rls(field: Field, p: Penalties, right: Sequence[str], weights: Sequence[str], hessian: Sequence[str] | None = None, bound="dct2", iterations: int = 1) -> Field:
    """``relax`` with a weight map; with the absolute penalty alone, voxels are independent and there are no colours."""
    stencils._check_weights(field, p, weights)
    b, (count, kind) = bound_of(bound), colours(p, field.ndim)
    if p.radius == 0:
        count, kind = 1, ""
    carry = list(dict.fromkeys([*field.channels, *right, *(hessian or ()), *weights]))
    now = field.with_df(field.df.select(*field.keys, *[F.col(c).cast("double").alias(c) for c in carry]))
    cut = Cuts()
    for step in range(iterations * count):
        op = stencils._Weighted(now, p, weights, b)
        chosen = colour_is(list(field.axes), kind, step) if kind else None
        near, n = op.gathered(True, carry), len(field.channels)
        near = near.withColumns({f"_m{k}": op.product(k) for k in range(n)} | {f"_d{k}": op.diagonal(k) for k in range(n)})
        table = _updated(near.select(*field.keys, *carry, *[f"_{x}{k}" for x in "md" for k in range(n)]), now, [F.col(f"_m{k}") for k in range(n)], [F.col(f"_d{k}") for k in range(n)], right, hessian, chosen)
        table = table.select(*field.keys, *carry)
        now = now.with_df(cut(table) if (step + 1) % CHECKPOINT_EVERY == 0 else table)
    return now


@dataclass(frozen=True)
class Solution:
    """A solved field, the steps made, and |residual| / |right hand side| (the plain residual if that is 0)."""

    field: Field
    iterations: int
    residual: float


def _dots(df: DataFrame, pairs: dict[str, tuple[Sequence[str], Sequence[str]]]) -> dict[str, float]:
    """Sums over all voxels of products of columns: one small row for the driver."""
    terms = []
    for name, (a, b) in pairs.items():
        total = None
        for x, y in zip(a, b):
            total = F.col(x) * F.col(y) if total is None else total + F.col(x) * F.col(y)
        terms.append(F.coalesce(F.sum(total), F.lit(0.0)).alias(name))
    return df.agg(*terms).first().asDict()


def cg(field: Field, p: Penalties, right: Sequence[str], hessian: Sequence[str] | None = None, bound="dct2", iterations: int = 32, tolerance: float = 1e-6) -> Solution:
    """Jacobi-preconditioned conjugate gradients for (H + L) x = g from x, the field's channels.

    Ends after ``iterations`` steps, when the residual is at most ``tolerance``
    times the right hand side (in size; itself if that is 0), or when a
    direction isn't one of descent.  Every batch is part of one system.
    """
    stencils._check(field, p)
    n, b = len(field.channels), bound_of(bound)
    cut = Cuts()
    x, names = list(field.channels), lambda k: [f"_{k}{i}" for i in range(n)]
    r, z, d, q = names("r"), names("z"), names("d"), names("q")
    h = stencils.hessian_columns(hessian, n)
    base = list(dict.fromkeys([*x, *right, *(hessian or ())]))
    full = [h[k] + stencils.diagonal(field.axes, p, b, k) for k in range(n)] + h[n:]

    def applied(df: DataFrame, v: Sequence[str], carry: Sequence[str], out: Sequence[str]) -> DataFrame:
        moved = stencils.apply_stencil(Field(df, field.axes, v, field.batch, field.gaps), p, b, carry=carry, out=out)
        hv = posdef.products(h, [F.col(c) for c in v])
        return moved.withColumns({o: F.col(o) + y for o, y in zip(out, hv)})

    table = field.df.select(*field.keys, *[F.col(c).cast("double").alias(c) for c in base])
    table = applied(table, x, base, q)
    table = table.withColumns({a: F.col(g) - F.col(y) for a, g, y in zip(r, right, q)}).drop(*q)
    table = posdef.solve_columns(table, full, [F.col(c) for c in r], z)
    table = cut(table.withColumns({a: F.col(c) for a, c in zip(d, z)}))
    sizes = _dots(table, {"gg": (right, right), "rr": (r, r), "rz": (r, z)})
    goal = (tolerance**2) * (sizes["gg"] or 1.0)
    done, rr, rz = 0, sizes["rr"], sizes["rz"]
    while done < iterations and rr > goal and rz > 0:
        table = cut(applied(table, d, [*base, *r, *d], q))
        dq = _dots(table, {"dq": (d, q)})["dq"]
        if dq <= 0:
            break
        alpha = F.lit(rz / dq)
        table = table.withColumns({a: F.col(a) + alpha * F.col(c) for a, c in zip(x, d)} | {a: F.col(a) - alpha * F.col(c) for a, c in zip(r, q)}).drop(*q)
        table = posdef.solve_columns(table, full, [F.col(c) for c in r], z)
        done += 1
        sizes = _dots(table, {"rr": (r, r), "rz": (r, z)})
        beta, rr, rz = F.lit(sizes["rz"] / rz), sizes["rr"], sizes["rz"]
        table = table.withColumns({a: F.col(c) + beta * F.col(a) for a, c in zip(d, z)})
    gg = _dots(table, {"gg": (right, right)})["gg"]
    return Solution(field.with_df(table.select(*field.keys, *base)), done, (rr / gg) ** 0.5 if gg else rr**0.5)
