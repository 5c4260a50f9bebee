"""Text files as rows, from a folder as it is or as a stream of what comes into it; what can't be read is counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.stored import Stored


def _rows(raw: DataFrame) -> DataFrame:
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return raw.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.when(good, F.col("content").cast("string")).alias("text"), (~good).alias("broken"))


def files(spark: SparkSession, folder: str, pattern: str = "*.txt", limit: int | None = None, least_bytes: int = 0) -> DataFrame:
    """path, modified, size, text and broken of the files in ``folder`` and below whose names fit ``pattern``, by Spark's own reader.

    A file that isn't UTF-8 is broken and has no text.  Files of fewer than ``least_bytes`` aren't opened.  With a limit,
    the first so many by path: the folder is listed, and only these are opened.  Spark's reader leaves empty files out.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if limit is None:
        return _rows(reader.load(folder).filter(F.col("length") >= least_bytes))
    chosen = [r.path for r in reader.load(folder).filter(F.col("length") >= least_bytes).select("path").orderBy("path").limit(limit).collect()]  # as many as asked for
    if not chosen:
        return _rows(reader.load(folder).limit(0))
    return _rows(spark.read.format("binaryFile").load(chosen))


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.txt", at_once: int = 10_000) -> DataFrame:
    """files() of ``folder`` (not below it) as a stream: each file once, at most ``at_once`` of them a batch."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return _rows(raw.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", at_once).load(folder))


def load_files(rows: DataFrame, table: Stored, least_chars: int = 0, batch: tuple[str, int] | None = None) -> dict[str, int]:
    """Insert files() into a stored table whose key is path; broken ones and those of fewer characters than ``least_chars`` stay out.

    Returns what the load itself counted, each file read once: found, errors (broken or short), inserted, and skipped
    (there already).
    """
    good = ~F.col("broken") & (F.length("text") >= least_chars)
    out = table.insert(rows.select(F.when(good, F.col("path")).alias("path"), "modified", "size", "text"), batch=batch)  # no key: an error
    return {k: out[k] for k in ("found", "errors", "inserted", "skipped")}


def load_new_files(stream: DataFrame, table: Stored, checkpoint: str, least_chars: int = 0) -> dict[str, int]:
    """load_files() of what a file_stream() has not brought yet, batch by batch, until it is all there; the batches' counts added up."""
    total = dict.fromkeys(("found", "errors", "inserted", "skipped"), 0)

    def one(batch: DataFrame, number: int) -> None:
        for k, n in load_files(batch, table, least_chars, (checkpoint, number)).items():
            total[k] += n

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return total
