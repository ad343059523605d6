"""Numbered commits in a folder of the shared storage: small JSON files that count from the
moment they stand under their name, and that no second writer can replace."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, value: dict) -> None:
    """Writes a commit whole: under a name of its own, then renamed without overwriting; the
    second of two rivals gets an OSError."""
    p, fs = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    fs_jvm = spark._jvm.org.apache.hadoop.fs
    rename = getattr(fs_jvm, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    try:
        fs_jvm.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(part, p, how)
    except Exception as e:
        fs.delete(part, False)
        raise OSError(f"{path} was committed by another run") from e


def get(spark: SparkSession, path: str) -> dict | None:
    p, fs = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def latest(spark: SparkSession, folder: str) -> int:
    """The greatest n of the files n.json of a folder, by one listing; -1 for none."""
    p, fs = _at(spark, folder)
    if not fs.exists(p):
        return -1
    names = (s.getPath().getName() for s in fs.listStatus(p))
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)
