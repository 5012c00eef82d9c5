"""Reading tables and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_SESSION = f"staged-{uuid.uuid4().hex[:8]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the dataset folder ``sf_dir`` (one file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode a temporary one is set where it is unset, on a cluster it must
    be set, since a folder of one machine isn't shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="scorelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staging_path(spark: SparkSession) -> str:
    """A new path of this process in the shared folder, removed by clear_staged."""
    return f"{shared_dir(spark)}/{_SESSION}-{uuid.uuid4().hex}"


def staged(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: lineage is cut, columns and partitions
    can still be pruned, and a lost executor costs only the tasks it was running."""
    spark = df.sparkSession
    path = staging_path(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Deletes what this process staged; results that were not written yet must not be read any more."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{_SESSION}-*")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(pattern) or []:
        fs.delete(found.getPath(), True)
