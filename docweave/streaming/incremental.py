"""Incremental indexing of a stream of file snapshots.

The state is the content hash of each path. Every micro-batch is compared
with it and only new contents go on, so a repeated or replayed file costs a
look-up. State versions are named by batch id and written after ``apply``: a
batch that fails in between is handed out again with the same id and the same
files, so ``apply`` has to bear that. The last two versions are kept, which is
what a repeated batch reads. A file that is gone from the source is not noticed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.operators.changes import diff_manifest
from docweave.operators.graph import last_wins

STATE = "path string, content_hash string"


def incremental(stream: DataFrame, state_path: str, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Start a query over stream(path, content, ordinal) that hands each batch's
    added and modified files, with their status, to ``apply``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = last_wins(batch.withColumn("content_hash", F.sha2("content", 256)), ("path",), "ordinal").persist()
        try:
            state = (
                spark.createDataFrame([], STATE) if batch_id == 0 else spark.read.schema(STATE).parquet(f"{state_path}/v{batch_id - 1}")
            )
            status = diff_manifest(latest, state).filter("status in ('added', 'modified')")
            apply(latest.join(status, "path"), batch_id)
            kept = state.join(latest.select("path"), "path", "left_anti")
            kept.unionByName(latest.select("path", "content_hash")).write.mode("overwrite").parquet(f"{state_path}/v{batch_id}")
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state_path}/v{batch_id - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        finally:
            latest.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
