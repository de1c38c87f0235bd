"""Where state goes that the driver and all executors must see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a new temporary one if driver and executors are one
    process, as in tests; on a cluster an error, as no other machine would see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _file(spark: SparkSession, path: str):
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one folder for the application, which goes when the driver ends."""
    root = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"
    file, files = _file(spark, root)
    if not files.exists(file):
        files.mkdirs(file)
        files.deleteOnExit(file)
    return f"{root}/{uuid.uuid4().hex}/{name}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    file, files = _file(spark, path)
    files.delete(file, True)
