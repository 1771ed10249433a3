"""Cutting lineage between rounds of an iteration."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that the session names, which
    driver and executors share. A folder of its own is made only in local mode,
    where none is named. It goes when the session ends."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docweave-"))
        named = context.getCheckpointDir()
    path = f"{named.rstrip('/')}/settled/{context.applicationId}"
    if path not in _made:
        there = context._jvm.org.apache.hadoop.fs.Path(path)
        system = there.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(there)
        system.deleteOnExit(there)
        _made.add(path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: computed once, and a lost
    executor costs a reread. Its rows may come back in another order."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
