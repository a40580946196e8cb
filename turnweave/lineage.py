"""Lineage cuts through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset and Spark runs in one process
    (tests), a temporary folder takes its place; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="turnweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside leave no shuffle files behind when they end."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written to the shared folder. What
    several branches of a plan read is computed once, and a lost executor costs
    no recomputation. The table goes with discard(), or when the application ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(folder)
    path, system = _path(spark, folder)
    system.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(folder)
    out.cut_folder = folder
    return out


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, read from a table in the shared folder that is dealt into
    spark.sql.shuffle.partitions buckets by ``keys``: joins on them move only
    their other side. The table goes as those of cut()."""
    spark = df.sparkSession
    name, buckets = f"cut_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{shared_folder(spark)}/{name}"
    with freed_shuffles(spark):
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", folder).saveAsTable(name)
    path, system = _path(spark, folder)
    system.deleteOnExit(path)
    out = spark.table(name)
    out.cut_folder, out.cut_table = folder, name
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by cut() or bucketed() that nothing reads any more."""
    for table in tables:
        if hasattr(table, "cut_table"):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.cut_table}")
        path, system = _path(table.sparkSession, table.cut_folder)
        system.delete(path, True)
