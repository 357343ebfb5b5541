"""Tables of one step, written to the folder that driver and executors share and read back, so that they are worked out once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the folder that driver and executors share: spark.checkpoint.dir has it; local runs without that setting have a folder of their own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table, written to a path of its own and read back."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table that lies in fewer pieces than there are cores is dealt out to all of them before its texts are worked on; one of many files stays as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dropped(table_path: str, spark: SparkSession) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop() -> None:
    """Results may read these tables to the end of the program."""
    for spark, path in _WRITTEN:
        try:
            dropped(path, spark)
        except Exception:  # the session is gone; the folder's owner cleans up
            return
