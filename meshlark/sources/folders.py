"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session gets a temporary folder and a cluster session is refused, as
    its machines do not see each other's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="meshlark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/meshlark/{name}-{uuid.uuid4().hex[:12]}"


def clear_folders(spark: SparkSession) -> None:
    """Remove all written intermediate tables, packages and streams of this library from the shared folder; for a time at
    which none of its results is still to be read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/meshlark")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
