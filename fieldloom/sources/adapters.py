"""Fields from arrays and back, and from parquet files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldloom.meta import Field

_AXES = ("x", "y", "z")
#: Values that may be brought to the driver as an array.
MAX_VALUES = 50_000_000


def from_numpy(spark: SparkSession, array: np.ndarray, ndim: int, batch: Sequence[str] = (), channels: Sequence[str] | None = None, partitions: int | None = None) -> Field:
    """A field of an array (*batch, *spatial, channels) of float32 or float64."""
    if array.dtype not in (np.float32, np.float64):
        raise ValueError("fields are of float32 or float64")
    if array.ndim != len(batch) + ndim + 1:
        raise ValueError("the array has batch, spatial and channel axes")
    names = tuple(channels or [f"v{i}" if array.shape[-1] > 1 else "v" for i in range(array.shape[-1])])
    places = np.indices(array.shape[:-1]).reshape(array.ndim - 1, -1)
    keys = [*batch, *_AXES[:ndim]]
    import pandas as pd

    table = pd.DataFrame({k: p.astype(np.int64 if k in batch else np.int32) for k, p in zip(keys, places)} | {c: array[..., i].ravel().astype(np.float64) for i, c in enumerate(names)})
    df = spark.createDataFrame(table)
    return Field(df.repartition(partitions) if partitions else df, dict(zip(_AXES, array.shape[len(batch) : -1])), names, batch)


def to_numpy(field: Field) -> np.ndarray:
    """The array (*batch, *spatial, channels) of a small field, batches in ascending order."""
    table = field.df.select(*field.keys, *field.channels).orderBy(*field.keys).limit(MAX_VALUES + 1).toPandas()
    if len(table) * len(field.channels) > MAX_VALUES:
        raise ValueError("the field is too large for one array")
    lead = [table[b].nunique() for b in field.batch]
    return table[list(field.channels)].to_numpy(float).reshape(*lead, *field.axes.values(), len(field.channels))


def read_parquet(spark: SparkSession, path: str, axes: Mapping[str, int], channels: Sequence[str] = ("v",), batch: Sequence[str] = ()) -> Field:
    """A field from parquet; only its columns are read."""
    return Field(spark.read.parquet(path).select(*batch, *[F.col(a).cast("int").alias(a) for a in axes], *channels), axes, channels, batch)


def write_parquet(field: Field, path: str, partition_by: Sequence[str] = ()) -> None:
    field.df.select(*field.keys, *field.channels).write.partitionBy(*partition_by).parquet(path)


def packed(field: Field, axis: str | None = None) -> DataFrame:
    """One row for each line along an axis: the other keys, and each channel as an array in order."""
    axis = axis or list(field.axes)[-1]
    rest = [k for k in field.keys if k != axis]
    rows = field.df.groupBy(*rest).agg(F.sort_array(F.collect_list(F.struct(axis, *field.channels))).alias("_l"))
    return rows.select(*rest, *[F.col("_l")[c].alias(c) for c in field.channels])
