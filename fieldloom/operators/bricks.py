"""Neighbourhoods of dense fields by bricks: blocks of voxels that a task holds as arrays.

Each voxel goes to its own brick, and voxels near a brick's faces to the brick
beyond them, too; so what is shuffled is the field and the bricks' halos, however
many taps a stencil has.  Within a brick everything is numpy.  A field that fits
one brick has no halo, and such fields of many batches are taken side by side.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fieldloom.functions import bounds
from fieldloom.meta import Bound

#: Voxels of a brick along each axis, by the number of axes.
SIZES = {1: 32_768, 2: 160, 3: 32}
#: Voxels that a task takes at once, if bricks are smaller.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Line:
    """One brick's stretch of an axis: its own places from ``low`` to before ``high``, and the places that it is sent."""

    low: int
    high: int
    sent: np.ndarray

    @classmethod
    def of(cls, n: int, size: int, brick: int, radius: int, bound: Bound) -> Line:
        low, high = brick * size, min(n, (brick + 1) * size)
        reach = range(low - radius, high + radius)
        places = {i % n for i in reach} if bound is Bound.DFT else {i for i in reach if 0 <= i < n}
        return cls(low, high, np.array(sorted(places)))

    def read(self, n: int, radius: int, bound: Bound) -> tuple[np.ndarray, np.ndarray]:
        """For each place from ``low`` - radius on: where what it holds is among the sent, and with which sign."""
        found = [bounds.place(i, n, bound) for i in range(self.low - radius, self.high + radius)]
        signs = np.array([s for _, s in found], float)
        return np.searchsorted(self.sent, [j if s else self.sent[0] for j, s in found]), signs


def _bricks_of(a: Column, n: int, size: int, radius: int, bound: Bound) -> Column:
    """The bricks that a voxel goes to along one axis."""
    last, own = (n - 1) // size, F.floor(a / size).cast("int")
    out = [own]
    if radius:
        out += [F.when((a % size < radius) & (own > 0), own - 1), F.when((a % size >= size - radius) & (own < last), own + 1)]
        if bound is Bound.DFT:
            out += [F.when(a < radius, F.lit(last)), F.when(a >= n - radius, F.lit(0))]
            if last and last * size + radius > n:  # the last brick is thinner than the reach
                out.append(F.when(a < last * size + radius - n, F.lit(last - 1)))
    return F.array_distinct(F.array_compact(F.array(*out)))


def _differ(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first isn't the one before it; null is null and NaN is NaN."""
    column = column.combine_chunks()
    one, two = column.slice(0, len(column) - 1), column.slice(1)
    same = pc.or_(pc.and_(pc.is_null(one), pc.is_null(two)), pc.fill_null(pc.equal(one, two), False))
    if pa.types.is_floating(column.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(one), pc.is_nan(two)), False))
    return ~same.to_numpy(zero_copy_only=False)


class Brick:
    """The values of equally placed bricks of several batches, as (batches, places...) arrays by column."""

    def __init__(self, lines: Sequence[Line], sizes: Sequence[int], radius: int, columns: Mapping[str, np.ndarray], there: np.ndarray | None = None):
        self.lines, self.sizes, self.radius, self.columns, self.there = lines, sizes, radius, columns, there
        self._padded: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def _signs(self, around: Sequence[Bound]) -> tuple[list[np.ndarray], np.ndarray]:
        read = [line.read(n, self.radius, b) for line, n, b in zip(self.lines, self.sizes, around)]
        sign = np.ones((1,) * (len(read) + 1))
        for k, (_, s) in enumerate(read):
            sign = sign * s.reshape([-1 if d == k + 1 else 1 for d in range(len(read) + 1)])
        return [i for i, _ in read], sign

    def read(self, column: str, offset: Sequence[int], around: Sequence[Bound]) -> tuple[np.ndarray, np.ndarray]:
        """What lies at an offset from each own voxel, without the boundary's sign, and that sign (0: nothing)."""
        key = (column, tuple(around))
        if key not in self._padded:
            places, sign = self._signs(around)
            at = np.ix_(np.arange(len(self.columns[column])), *places)
            self._padded[key] = self.columns[column][at], sign if self.there is None else sign * self.there[at]
        values, sign = self._padded[key]
        cut = tuple(slice(self.radius + o, self.radius + o + line.high - line.low) for o, line in zip(offset, self.lines))
        return values[(slice(None), *cut)], sign[(slice(None), *cut)]


def mapped(df: DataFrame, batch: Sequence[str], axes: Mapping[str, int], radius: int, bound: Bound, columns: Sequence[str], carry: Sequence[str], out: Sequence[str], made: Callable[[Brick], dict[str, np.ndarray]], gaps: bool = False) -> DataFrame:
    """The keys, the double columns ``out`` that ``made`` gives for each brick's own voxels (null where masked), and ``carry`` columns as doubles.

    ``columns`` are read as doubles.  A batch must have each voxel once, or with
    ``gaps`` once at most, else the query fails; all voxels of a brick meet in one task, whose size is bounded.
    """
    names, size = list(axes), SIZES[len(axes)]
    counts = [-(-n // size) for n in axes.values()]
    marks = [f"_b_{a}" for a in names]
    rows = df.select(*batch, *[F.col(a).cast("int").alias(a) for a in names], *[F.col(c).cast("double").alias(f"_c_{c}") for c in dict.fromkeys([*columns, *carry])])
    for mark, (a, n), count in zip(marks, axes.items(), counts):
        rows = rows.withColumn(mark, F.explode(_bricks_of(F.col(a), n, size, radius, bound)) if count > 1 else F.lit(0))
    keys = [*batch, *[m for m, count in zip(marks, counts) if count > 1]]
    dealt = (rows.repartition(*keys) if keys else rows.coalesce(1)).sortWithinPartitions(*batch, *marks, *names)
    schema = T.StructType([*df.select(*batch).schema.fields, *[T.StructField(a, T.IntegerType()) for a in names], *[T.StructField(c, T.DoubleType()) for c in (*out, *carry)]])
    sizes = list(axes.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[tuple[int, ...], list[Line]] = {}
        held: pa.Table | None = None

        def refuse() -> None:
            raise ValueError("a batch has a voxel of the field more than once, or others" if gaps else "a batch doesn't have each voxel of the field once")

        def begins(table: pa.Table) -> np.ndarray:
            """Where rows of another brick or batch begin."""
            new = np.zeros(table.num_rows, bool)
            new[0] = True
            for name in (*batch, *marks):
                new[1:] |= _differ(table.column(name))
            return np.flatnonzero(new)

        def with_gaps(table: pa.Table, at: list[Line]) -> pa.RecordBatch:
            shape, first = [len(line.sent) for line in at], begins(table)
            places = [np.searchsorted(line.sent, table.column(a).to_numpy()) for a, line in zip(names, at)]
            for a, line, place in zip(names, at, places):
                if not np.array_equal(line.sent[np.minimum(place, len(line.sent) - 1)], table.column(a).to_numpy()):
                    refuse()
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
            flat = np.ravel_multi_index((group, *places), (len(first), *shape))
            if (np.diff(flat) <= 0).any():
                refuse()
            whole = [len(first), *shape]
            there = np.zeros(whole, bool)
            there.ravel()[flat] = True
            values = {c: np.zeros(whole) for c in columns}
            for c, v in values.items():
                v.ravel()[flat] = table.column(f"_c_{c}").to_numpy()
            results = made(Brick(at, sizes, radius, values, there))
            own = [np.flatnonzero((line.sent >= line.low) & (line.sent < line.high)) for line in at]
            inside = np.zeros(shape, bool)
            inside[np.ix_(*own)] = True
            kept = table.filter(pa.array(inside[tuple(places)]))
            wanted = there[np.ix_(np.arange(len(first)), *own)]
            arrays = [kept.column(b) for b in (*batch, *names)]
            for name in out:
                gone = np.broadcast_to(results[name].mask, wanted.shape)[wanted] if np.ma.isMaskedArray(results[name]) else None
                arrays.append(pa.array(np.broadcast_to(np.ma.getdata(results[name]), wanted.shape)[wanted], pa.float64(), mask=gone))
            arrays += [kept.column(f"_c_{c}") for c in carry]
            return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], schema.names)

        def bricks(table: pa.Table, at: list[Line], expected: np.ndarray) -> pa.RecordBatch:
            shape, each = [len(line.sent) for line in at], len(expected[0])
            groups = table.num_rows // each
            for a, e in zip(names, expected):
                if not np.array_equal(table.column(a).to_numpy().reshape(groups, each), np.broadcast_to(e, (groups, each))):
                    refuse()
            values = {c: table.column(f"_c_{c}").to_numpy().reshape([groups, *shape]) for c in dict.fromkeys([*columns, *carry])}
            own = tuple(np.flatnonzero((line.sent >= line.low) & (line.sent < line.high)) for line in at)
            results = made(Brick(at, sizes, radius, {c: values[c] for c in columns}))
            inside = np.zeros(shape, bool)
            inside[np.ix_(*own)] = True
            kept = table.filter(pa.array(np.tile(inside.ravel(), groups)))
            arrays = [kept.column(b).combine_chunks() for b in (*batch, *names)]
            for name in out:
                whole = [groups, *[len(o) for o in own]]
                gone = np.broadcast_to(results[name].mask, whole).ravel() if np.ma.isMaskedArray(results[name]) else None
                arrays.append(pa.array(np.broadcast_to(np.ma.getdata(results[name]), whole).ravel(), pa.float64(), mask=gone))
            arrays += [pa.array(values[c][np.ix_(np.arange(groups), *own)].ravel(), pa.float64()) for c in carry]
            return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], schema.names)

        for arrived in itertools.chain(batches, [None]):
            if arrived is not None:
                held = pa.Table.from_batches([arrived]) if held is None else pa.concat_tables([held, pa.Table.from_batches([arrived])])
            while held is not None and held.num_rows:
                which = tuple(held.column(m)[0].as_py() for m in marks)
                if which not in lines:
                    lines[which] = [Line.of(n, size, k, radius, bound) for n, k in zip(sizes, which)]
                at = lines[which]
                if gaps:
                    if arrived is not None and max(counts) == 1 and held.num_rows < CHUNK:
                        break
                    ends = begins(held)[1:]
                    if arrived is None:  # else more rows of the last one may come
                        ends = np.append(ends, held.num_rows)
                    if not len(ends):
                        break
                    ready = min(len(ends), max(1, CHUNK // math.prod(len(line.sent) for line in at))) if max(counts) == 1 else 1
                    yield with_gaps(held.slice(0, int(ends[ready - 1])), at)
                    held = held.slice(int(ends[ready - 1]))
                    continue
                expected = [g.ravel() for g in np.meshgrid(*[line.sent for line in at], indexing="ij")]
                each = len(expected[0])
                ready = held.num_rows // each if max(counts) == 1 else min(1, held.num_rows // each)
                if not ready or max(counts) == 1 and arrived is not None and held.num_rows < CHUNK:
                    if arrived is None:
                        refuse()
                    break
                yield bricks(held.slice(0, ready * each), at, expected)
                held = held.slice(ready * each)

    return dealt.mapInArrow(run, schema)
