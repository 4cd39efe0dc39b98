"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def folder(spark: SparkSession, tag: str) -> str:
    """A new name in the shared folder of spark.checkpoint.dir. Only where it is
    unset and the master is local, in a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="stowage-files-"))
            atexit.register(shutil.rmtree, _own[0], True)
        root = _own[0]
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path constructor) for a path."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make
