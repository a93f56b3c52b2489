"""Folders that queries write to on their way."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def workspace(spark: SparkSession) -> str:
    """A new folder under the shared one the cluster names."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="tidewatch-work-")
    return os.path.join(root, f"run-{uuid.uuid4().hex}")


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a folder, as its file system reports them."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
