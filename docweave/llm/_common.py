"""Helpers shared by the training-data operators.

``stage`` cuts lineage by writing a table to the folder that
``spark.checkpoint.dir`` names, so a lost executor costs a reread and not a
recomputation. Where the session names no folder, one is made once and set on
the context, in local mode only: on a cluster that is an error. Tables go when
the session ends, those of a loop as soon as the next round stands.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python step handles at a time.
SLICE_BYTES = 8 << 20
#: Rows of a few numbers that may be sent to every executor: about 20 MB.
SENT_ROWS = 400_000
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = spark.sparkContext.getCheckpointDir()
        if not given:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docweave-"))
            given = spark.sparkContext.getCheckpointDir()
        root = given
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def own_dir(spark: SparkSession, kind: str) -> str:
    """A folder of this application in the shared one, which goes with it."""
    path = f"{shared_dir(spark)}/{kind}/{spark.sparkContext.applicationId}"
    if path not in _made:
        system, there = _file_system(spark, path)
        system.mkdirs(there)
        system.deleteOnExit(there)
        _made.add(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{own_dir(spark, 'tables')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._staged = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        system, there = _file_system(df.sparkSession, df._staged)
        system.delete(there, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_text(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls are empty."""
    array = array.cast(pa.large_string())
    if array.null_count:
        array = pc.fill_null(array, "")
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if len(array) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lean(step):
    """A mapInArrow step that gives unused memory back when its task ends, as
    the worker process lives on beside the executor's other tasks."""

    def run(batches):
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a batch where its text column passes ``limit`` bytes; a single
    longer text stays whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, n = 0, len(sizes)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out_starts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - out_starts, lengths)


def bounded_collect(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that is small by construction; more than ``limit`` is an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}")
    return rows


def sent_if_few(df: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """A written table of narrow rows, marked to be sent to every executor if
    it has at most ``most`` rows, so that what it is joined with stays where it
    is. A larger one is joined by shuffling."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def words(column):
    """Runs of characters other than ASCII white space."""
    return F.regexp_extract_all(column, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
