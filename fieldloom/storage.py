"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only on one machine, where that is unset, a folder of this machine for each application."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        folder = _own.get(key) or _own.setdefault(key, "file://" + tempfile.mkdtemp(prefix="fieldloom-"))
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows of ``df`` as a table in the shared folder, and its path: lineage ends there, and a lost executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/fieldloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``written`` made."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
