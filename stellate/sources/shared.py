"""Folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, a local master, as in tests, gets one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def opened(uri: str):
    """A file of any file system that Arrow knows, for reading in a task."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    system, path = arrow_fs.FileSystem.from_uri(uri) if "://" in uri else (arrow_fs.LocalFileSystem(), uri)
    return system.open_input_file(path)
