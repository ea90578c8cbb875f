"""Field operators on streams: points that arrive are sampled from, or splatted on, a field that is at rest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from fieldloom.meta import Field, bound_of, spline_of
from fieldloom.operators import sampling


def pull_each_batch(field: Field, loc: Sequence[str], ids: Sequence[str], sink, order: int | str = 2, bound: int | str = "dct2", extrapolate: int = 1):
    """A function for ``writeStream.foreachBatch``: each micro-batch of points is sampled, and ``sink(samples, epoch)`` called."""

    def handle(points: DataFrame, epoch: int) -> None:
        sink(sampling.pull(field, sampling.Points(points, ids, loc, field.batch), order, bound, extrapolate), epoch)

    return handle


def push_stream(points: DataFrame, loc: Sequence[str], channels: Sequence[str], axes: Mapping[str, int], batch: Sequence[str] = (), order: int | str = 2, bound: int | str = "dct2", extrapolate: int = 1) -> DataFrame:
    """A running ``push`` of a stream of points, for output mode "update" or "complete": sums of the voxels that were met; others are 0."""
    order, bound = spline_of(order), bound_of(bound)
    tapped = sampling.taps(points, loc, axes, order, bound, extrapolate)
    weight = sampling._product(list(axes))
    rows = tapped.select(*batch, *[F.col(f"_i_{a}").alias(a) for a in axes], *[(weight * F.col(c).cast("double")).alias(c) for c in channels])
    return rows.groupBy(*batch, *axes).agg(*[F.sum(c).alias(c) for c in channels])
