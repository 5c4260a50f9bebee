"""Queries that read their table as a stream: what is there, once, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.sources.stored import Stored
from lodestone.sources.tables import table
from lodestone.streaming import sync
from lodestone.streaming.state import load


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    # a pattern, as a stream's plain path has to be a folder, and a table may be a single file
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.[p]arquet")


@query("SELECT doc_id, any_value(CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'old' END) AS came FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY doc_id")
def stream_sync(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a label are there; the stream of all documents adds the others, each batch to the buckets it falls into."""
    place = sync.new_folder(spark, "synced")
    target = Stored(spark, f"{place}/table", "doc_id", buckets=8)
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    target.insert(docs.join(labels, "doc_id", "left_semi").withColumn("came", F.lit("old")))
    coming = stream_of(spark, d, "documents").select("doc_id", F.lit("new").alias("came"))
    load(coming, target, "documents", f"{place}/state").awaitTermination()
    return target.read().select("doc_id", "came")


@query("""
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type
    HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR
""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type, of the hours that are over two hours before the last event."""
    events = stream_of(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = sync.run_to_table(sync.windowed_counts(events, "ts", "1 hour", "2 hours", "event_type"), spark, "windows")
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


@query("SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The users of a stream of events, each once, however long ago it was seen: they are kept in a table, not in the stream's state."""
    place = sync.new_folder(spark, "seen")
    seen = Stored(spark, f"{place}/table", "user_id", buckets=8)
    load(stream_of(spark, d, "events").select("user_id"), seen, "events", f"{place}/state").awaitTermination()
    return seen.read()
