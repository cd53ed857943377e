"""Where intermediate tables go: the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path; below a temporary one of our own only where the setting is unset, in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plenaria-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/plenaria/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``work_dir`` that is no longer read."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new work folder and read back: its lineage ends there. The folder goes when the application
    ends, since what is made of it may be read until then."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may have ended first; the folder's owner sweeps it then
            drop(spark, path)


atexit.register(_clean)
