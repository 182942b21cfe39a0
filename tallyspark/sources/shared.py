"""Tables that a query writes for itself in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder where it is unset and Spark runs in one process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = Path(tempfile.mkdtemp(prefix="shared-")).as_uri()
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back, which cuts its lineage. It is removed by forget(), or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_removed, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def forget(*tables: DataFrame) -> None:
    """Remove tables made by written() that nothing will read any more."""
    for table in tables:
        if path := _paths.pop(table, None):
            _removed(table.sparkSession, path)


def _removed(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder goes with it
        return
