"""Boundary conditions: where an index beyond the ends points to, and with which sign."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldloom.meta import Bound, bound_of

#: The condition that a field's cross derivative sees along the differentiated axis.
TRANSPOSED = {Bound.DCT1: Bound.DST1, Bound.DST1: Bound.DCT1, Bound.DCT2: Bound.DST2, Bound.DST2: Bound.DCT2}


def transposed(bound: Bound) -> Bound:
    return TRANSPOSED.get(bound, bound)


def place(i: int, n: int, bound: int | str | Bound) -> tuple[int, int]:
    """(index, sign) of position ``i`` in a line of ``n``; the index means nothing where the sign is 0."""
    bound = bound_of(bound)
    if bound in (Bound.ZERO, Bound.NOCHECK):
        return i, int(0 <= i < n)
    if bound is Bound.REPLICATE:
        return min(max(i, 0), n - 1), 1
    if bound is Bound.DFT:
        return i % n, 1
    if bound in (Bound.DCT2, Bound.DST2):
        period, r = divmod(i, 2 * n)
        back = r >= n
        return (2 * n - 1 - r if back else r), (-1 if bound is Bound.DST2 and back else 1)
    if bound is Bound.DCT1:
        if n == 1:
            return 0, 1
        r = i % (2 * (n - 1))
        return (2 * (n - 1) - r if r >= n else r), 1
    if n == 1:  # DST1
        return 0, 1
    r = i % (2 * (n + 1))
    if r == n or r == 2 * n + 1:
        return 0, 0
    return (r, 1) if r < n else (2 * n - r, -1)


def index_and_sign(i: Column, n: int, bound: int | str | Bound) -> tuple[Column, Column]:
    """``place`` for a column of positions; the index is null where the sign is 0."""
    bound = bound_of(bound)
    i, one = i.cast("int"), F.lit(1)
    inside = i.between(0, n - 1)
    if bound in (Bound.ZERO, Bound.NOCHECK):
        return F.when(inside, i), F.when(inside, one).otherwise(0)
    if bound is Bound.REPLICATE:
        return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)), one
    if bound is Bound.DFT:
        return F.pmod(i, F.lit(n)), one
    if bound in (Bound.DCT2, Bound.DST2):
        r = F.pmod(i, F.lit(2 * n))
        return F.when(r < n, r).otherwise(2 * n - 1 - r), one if bound is Bound.DCT2 else F.when(r < n, one).otherwise(-1)
    if n == 1:
        return F.lit(0), one
    if bound is Bound.DCT1:
        r = F.pmod(i, F.lit(2 * (n - 1)))
        return F.when(r < n, r).otherwise(2 * (n - 1) - r), one
    r = F.pmod(i, F.lit(2 * (n + 1)))
    ghost = (r == n) | (r == 2 * n + 1)
    return F.when(r < n, r).when(~ghost, 2 * n - r), F.when(r < n, one).when(ghost, 0).otherwise(-1)
