"""What the corpus operators share: tables cut off in shared storage, and blocks of rows from Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step of a vectorised operator works on (at least one document).
BLOCK_BYTES = 1 << 19


#: Bytes of rows that Spark hands to a Python worker at once, in place of its default of 10,000 rows of any size.
BATCH_BYTES = 4 << 20


def bound_batches(docs: DataFrame) -> DataFrame:
    """docs, with the session set to hand texts over in batches bounded by bytes."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which every executor sees.

    Where it is unset (tests on one machine) a folder of this machine serves; a cluster without the setting is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


#: Frees a query's shuffle files once it has ended, where Spark knows the setting.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, fixes a plan's estimates.

    The shuffle files behind it go as soon as it is written. Tables that a lazy result still reads stay until the
    application ends, when its whole folder is deleted; others are discarded by their users.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/tidewell-{spark.sparkContext.applicationId}"
    fs, p = _path(spark, folder)
    fs.deleteOnExit(p)
    path = f"{folder}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes stashed tables that no later plan reads."""
    for df in frames:
        fs, p = _path(df.sparkSession, df._stash_path)
        fs.delete(p, True)


@dataclass
class Block:
    """Rows start..stop of a batch; data holds their texts' UTF-8 end to end, row i at offsets[i]:offsets[i + 1]."""

    start: int
    stop: int
    data: np.ndarray
    offsets: np.ndarray


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column (null: empty) into blocks of about limit bytes, without copying texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        stop = min(stop, len(column))
        yield Block(start, stop, raw[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
        start = stop
