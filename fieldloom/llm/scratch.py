"""Tables written in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset, as in tests, a folder of this machine for each application."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        folder = _own.get(key) or _own.setdefault(key, "file://" + tempfile.mkdtemp(prefix="fieldloom-"))
    return folder.rstrip("/")


_sweeping = threading.local()


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Removes all tables that are begun within, when it ends; whatever is read from them must be written elsewhere by then."""
    outer, own = getattr(_sweeping, "paths", None), []
    _sweeping.paths = own
    try:
        yield
    finally:
        _sweeping.paths = outer
        for path in own:
            remove(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A folder for a table, which doesn't exist yet, in the shared folder."""
    path = f"{shared_folder(spark)}/fieldloom/{name}-{uuid.uuid4().hex}"
    if getattr(_sweeping, "paths", None) is not None:
        _sweeping.paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: lineage ends there, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df_or_path: DataFrame | str) -> None:
    """Deletes a table that ``written`` made, or a path from ``new_path``."""
    paths = [df_or_path] if isinstance(df_or_path, str) else {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    jvm = spark.sparkContext._jvm
    for path in paths:
        if "/fieldloom/" not in path:
            raise ValueError(f"not a scratch table: {path}")
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of at most a few hundred bytes that a broadcast may hold.
BROADCAST_ROWS = 50_000


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcasting only if it has at most ``rows`` rows (counted from its footers); else joins shuffle."""
    return F.broadcast(table) if table.count() <= rows else table
