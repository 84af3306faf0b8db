"""Shared storage: tables that cut lineage and survive the loss of an executor."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="skeinwork-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Rows of an Arrow batch while a table is written: texts of the JVM and of its Python workers then take a few MB each.
ARROW_ROWS = 2000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; removed when the driver ends."""
    spark = df.sparkSession
    path, schema = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", df.schema
    usual = spark.conf.get(_ARROW)
    spark.conf.set(_ARROW, min(int(usual), ARROW_ROWS) if int(usual) > 0 else ARROW_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW, usual)
    atexit.register(_remove, spark, path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # shuffle files of steps that ended go when their plans do
    return spark.read.schema(schema).parquet(path)


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that others can't clash with working columns."""
    return df.select(*[F.col(f"`{column}`").alias(name) for name, column in columns.items()])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
