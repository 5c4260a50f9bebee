"""Tables that cut lineage: written once in the folder that all executors share, then read from there.

The folder is the session's ``spark.checkpoint.dir``.  Only where a session has
none (tests on one machine) is a folder made for it.  A table written here
survives lost executors, and what was numbered while writing (row ids, local
representatives) keeps its numbers however often the readers run again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def folder(spark: SparkSession) -> str:
    """The shared folder; made, and set as the checkpoint folder, only where the session names none."""
    conf = spark.sparkContext.getConf()
    where = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not where:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of about ``most`` bytes (or one longer row) in jobs started inside; Spark's own limit counts rows, whatever their texts' length."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, most)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def arrow(frame: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, most: int = 4 << 20) -> DataFrame:
    """frame.mapInArrow() in batches of about ``most`` bytes, or one longer row.

    Spark reads the bound when the job starts, long after this call. So it is put into the session's settings, where
    these don't name a bound already; a session's own bound stays. It changes the size of batches only, no result.
    """
    if frame.sparkSession.conf.get(BATCH_BYTES, None) is None:
        frame.sparkSession.conf.set(BATCH_BYTES, most)
    return frame.mapInArrow(function, schema)


def keep(frame: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``frame`` to the shared folder and return the written table; for whole texts ``zstd`` takes less disk."""
    spark = frame.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path, compression=codec)
    out = spark.read.schema(frame.schema).parquet(path)
    out._lodestone_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables made by keep() that no later plan reads."""
    for frame in frames:
        path = getattr(frame, "_lodestone_path", None)
        if path:
            jvm = frame.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
