"""Parquet sources, and spreading of inputs that are a single split."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from guidemill.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give CPU-heavy text work every core when the input has fewer splits than there are cores.

    A file with one row group is one task.  Larger inputs arrive in enough splits and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared checkpoint folder, read again: one job, no lineage.

    A lost executor costs a re-read.  The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
