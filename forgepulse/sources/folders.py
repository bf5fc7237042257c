"""Folders that driver and executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a fresh folder below `spark.checkpoint.dir`.

    Where that is unset, a cluster has no folder its machines are known to share, which is an
    error; a local session, which is one machine, gets a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="forgepulse-")
    return f"{base.rstrip('/')}/{name}-{os.urandom(8).hex()}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored at a path of any file system Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
