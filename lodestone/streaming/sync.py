"""Incremental loads as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.relations import new_rows
from lodestone.sources.versions import new_folder


def append_new(stream: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's rows whose key the Parquet table ``target`` doesn't have; runs until what is there has been read.

    A batch that is run again after a failure finds its own rows and adds none.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates([key])
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        (new_rows(once, spark.read.parquet(target), [key]) if there else once).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first event of each key within a watermark; state is dropped as the watermark passes."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, every: str, late: str, *keys: str) -> DataFrame:
    """Rows in each window of event time and for each of the keys: start, the keys, n; a window is given out once no more than ``late`` rows can come."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, every).alias("_window"), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("_window.start").alias("start"), *keys, "n")


def run_to_table(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run a stream in append mode over what is there, and return what it wrote."""
    target = new_folder(spark, name)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)
