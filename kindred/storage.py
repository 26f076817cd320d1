"""Folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, deleted when the driver ends.

    Only a local master without that setting (tests on one machine) gets a
    folder of its own; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="kindred-")
        context.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/kindred-{name}-{uuid.uuid4().hex}"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read again, for frames that several branches read."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
