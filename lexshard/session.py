"""What every operator needs of its session: tables, shared folders, spreading of rows."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


#: Tables of more bytes than this are never reshuffled to spread them.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a small table's files alone give fewer partitions than there are cores.

    A table of one small file is one partition; CPU-bound work on it would run on one core. A larger one is split by
    the scan (spark.sql.files.maxPartitionBytes) and passes through without a shuffle.
    """
    spark = df.sparkSession
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only where the setting is absent on a single machine (tests) a temporary folder is made and set; it goes when Python ends.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="lexshard-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        where = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Folders written by settled in this process and not yet removed.
_SETTLED: set[str] = set()


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, for something that clear_settled may remove."""
    path = os.path.join(shared_dir(spark), f"settled-{uuid.uuid4().hex}")
    _SETTLED.add(path)
    return path


def settled(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows, written once to the shared folder and read back: lineage ends, a lost executor loses nothing.

    The folder is removed by unsettled, or clear_settled when all that reads it is done.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    (df.select(*columns) if columns else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.select(*columns).schema if columns else df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _SETTLED.discard(path)


def unsettled(df: DataFrame) -> None:
    """Removes what settled wrote; df, and all that comes of it, can't be read any more."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        for mine in [p for p in _SETTLED if os.path.basename(p) == os.path.basename(path)]:
            _remove(df.sparkSession, mine)


def clear_settled(spark: SparkSession) -> None:
    """Removes all that settled wrote in this process; call it when no result is to be read any more."""
    for path in list(_SETTLED):
        _remove(spark, path)


def single(df: DataFrame) -> tuple:
    """The values of an aggregate without grouping: one row, whatever the size of the input."""
    return tuple(df.first())


def as_long(col) -> "F.Column":
    return col.cast(T.LongType())
