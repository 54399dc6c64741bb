"""The shared folder and materialised tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.  Where that is unset (tests, one machine) a temporary folder serves."""
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = got.get() if got.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veldspar-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/veldspar-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it again."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished stages: it acts when plans that hold them are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no later step reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
