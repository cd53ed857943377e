"""Shared helpers of the training-data operators: table reads, scratch tables, size-checked joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.views import spread

#: Most bytes of a side that may be broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20

#: A value is hot if more than one in so many rows hold it.
HOT_VALUES = 512

_made: list[tuple[SparkSession, str, str | None]] = []


def table(spark: SparkSession, sf_dir: str, name: str, even: bool = False) -> DataFrame:
    """even: deal out the rows of a table of one or few small files, for work that costs more than that."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if even else df


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of our own in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="plenaria-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: the lineage ends there, and lost
    executors cost only the tasks that read it. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/plenaria/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget_at_exit(spark: SparkSession, path: str, table_name: str | None = None) -> None:
    """Drop the table and delete the folder when the application ends."""
    _made.append((spark, path, table_name))


def _clean() -> None:
    for spark, path, name in _made:
        try:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended first; the folder's owner sweeps it then
            continue


atexit.register(_clean)


def fits(df: DataFrame, row_bytes, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df``, by the measured sum of ``row_bytes``, stay under the broadcast bound."""
    total = df.select(F.sum(row_bytes).alias("b")).first()["b"]
    return (total or 0) <= limit


def small_join(left: DataFrame, right: DataFrame, on, how: str, row_bytes) -> DataFrame:
    """Join with a broadcast of ``right`` if its measured size allows it, by shuffle otherwise."""
    return left.join(F.broadcast(right) if fits(right, row_bytes) else right, on, how)


def spread_join(left: DataFrame, right: DataFrame, on: str, total: int, how: str = "inner", row_bytes=None) -> DataFrame:
    """Join (inner or left) with ``right``, which has one row for each value of ``on`` and, as ``n``, how many
    rows of ``left`` hold it, of ``total`` in all. Values of more than a 512th of the rows (so fewer than 512
    values) are sent to all tasks, so that no task gets their rows; the others are joined as ever. ``n``
    goes. row_bytes: the size of a row of ``right``, if it has no bound; too many bytes aren't sent."""
    often = F.col("n") > total // HOT_VALUES
    if (right.agg(F.max("n")).first()[0] or 0) <= total // HOT_VALUES:
        return left.join(right.drop("n"), on, how)
    values = [c for c in right.columns if c not in (on, "n")]
    hot = right.filter(often).select(on, F.struct(*values).alias("_hot"))
    if row_bytes is not None and not fits(right.filter(often), row_bytes):
        return left.join(right.drop("n"), on, how)
    marked = left.join(F.broadcast(hot), on, "left")
    names = [c for c in left.columns if c != on]
    here = marked.filter("_hot IS NOT NULL").select(on, *names, *(F.col("_hot")[c].alias(c) for c in values))
    rest = marked.filter("_hot IS NULL").drop("_hot").join(right.filter(~often).drop("n"), on, how)
    return here.unionByName(rest.select(*here.columns))
