"""Parquet tables of a data folder, and the shared folder for written intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a folder that holds one parquet table per name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors see; it is deleted
    when the session's JVM ends.

    Only where that setting is unset on a single machine (master local) a folder of this
    machine is made and set; on a cluster the setting must name shared storage.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a written intermediate that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def once(df: DataFrame, key: str) -> DataFrame:
    """Rows that occur several times as exact copies (same key, same values) counted once.

    Rows without key are kept as they are: a null key identifies nothing.
    """
    firsts: list[Column] = [F.first(c).alias(c) for c in df.columns if c != key]
    keyed = df.where(F.col(key).isNotNull()).groupBy(key).agg(*firsts).select(*df.columns)
    return keyed.unionByName(df.where(F.col(key).isNull()))
