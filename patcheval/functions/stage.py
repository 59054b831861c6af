"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="patcheval-")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local session, whose driver and executors are
    one process, gets a temporary folder; a cluster, whose machines share none, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _test_folder()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path not used so far. What is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str = "stage") -> tuple[DataFrame, str]:
    """:func:`staged`, and the folder of the table, for :func:`remove`."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """The rows of ``df``, written once and read back: what follows reads a table, in as few columns
    as it needs, however often it uses it and whichever executors are lost meanwhile."""
    return written(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes the table of a :func:`written` stage that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """Text work is bound by cores, and a scan of few row groups has few tasks with rows, however many splits there are. Rows of such
    a scan are dealt out to all cores; a scan whose rows lie in enough tasks of its own is left alone."""
    cores, tasks = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if tasks >= cores:
        # numbers of rows come from the footers
        held = df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
        if not held.rows or held.most * cores <= 1.5 * held.rows:
            return df
    return df.repartition(max(cores, tasks))
