"""Session helpers shared by the training-data operators.

Intermediate tables live in the folder the cluster names in
``spark.checkpoint.dir`` (shared by all executors), so a lost executor costs a
re-read, never a re-computation of a whole lineage.
"""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its rows, at their estimated width, take at most this many bytes.
BROADCAST_BYTES = 32 << 20
#: Arrow batches between the JVM and Python hold at most about so many bytes, in either's memory.
BATCH_BYTES = 4 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quernel-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def bounded(spark: SparkSession) -> None:
    """Lower the session's limit for the bytes of an Arrow batch to ``BATCH_BYTES``: rows of long texts would else come in batches of 64 MB, in several copies."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "64m")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage is cut and columns stay prunable."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; keeps partitions and their order."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pieces(rows: int, per: int, least: int = 1) -> int:
    """How many pieces hold ``rows`` at ``per`` each."""
    return max(least, math.ceil(rows / per))


_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4}


def small(df: DataFrame, rows: int, wide: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` hinted for broadcast if its known row count times its width permits, else left to the optimizer's shuffle join.

    A row counts 32 bytes, and each column its own, ``wide`` for one of no fixed width.
    """
    width = 32 + sum(_WIDTHS.get(kind, 8 if re.match("bigint|double|date|timestamp", kind) else wide) for _, kind in df.dtypes)
    return F.broadcast(df) if rows * width <= limit else df


def slices(batch, column: str, most: int = 1 << 19):
    """Cut an Arrow batch into row ranges of about ``most`` bytes of ``column`` (one row at least), so a worker's arrays stay small; what they took is given back after the batch."""
    import numpy as np
    import pyarrow as pa

    values = batch.column(column)
    kind = np.int64 if str(values.type).startswith("large") else np.int32
    ends = np.frombuffer(values.buffers()[1], dtype=kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
