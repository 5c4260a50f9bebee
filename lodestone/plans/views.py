"""The test tables under the names that the reports use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import table


def cases(spark: SparkSession, folder: str, win: bool = True) -> DataFrame:
    """Documents as cases, with their quality label; without ``win`` the labels are not joined."""
    docs = table(spark, folder, "documents")
    docs = docs.join(table(spark, folder, "labels"), "doc_id", "left") if win else docs
    court = F.when(F.col("lang") == "en", "A").when(F.col("lang") == "fr", "B").when(F.col("lang") == "de", "C").otherwise("D")
    return docs.select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), F.col("source").alias("section"), court.alias("court"),
        (2005 + F.col("doc_id") % 20).alias("year"), *([F.col("quality").alias("win")] if win else []), (F.col("doc_id") % 3).alias("verified"), "text",
    )


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Events as evidence rows."""
    k = F.col("event_id")
    status = F.when(k % 3 == 0, "available").when(k % 3 == 1, "pending").otherwise("unavailable")
    outcome = F.when(k % 4 == 0, "accepted").when(k % 4 == 1, "rejected").when(k % 4 == 2, "partial")
    return table(spark, folder, "events").select(
        k.alias("id"), F.col("user_id").alias("case_id"), F.col("event_type").alias("section"), F.concat(F.lit("doc_"), (F.col("user_id") % 40).cast("string")).alias("name"),
        status.alias("status"), (k % 2 == 1).alias("mandatory"), outcome.alias("outcome"), F.col("ts").alias("created"),
    )


#: The same views for DuckDB.
CASES_SQL = """
    SELECT d.doc_id AS id, substr(d.text, 1, 60) AS title, d.source AS section,
           CASE d.lang WHEN 'en' THEN 'A' WHEN 'fr' THEN 'B' WHEN 'de' THEN 'C' ELSE 'D' END AS court,
           2005 + d.doc_id % 20 AS year, l.quality AS win, d.doc_id % 3 AS verified, d.text AS text
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
EVIDENCE_SQL = """
    SELECT event_id AS id, user_id AS case_id, event_type AS section, 'doc_' || CAST(user_id % 40 AS VARCHAR) AS name,
           CASE event_id % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'pending' ELSE 'unavailable' END AS status, event_id % 2 = 1 AS mandatory,
           CASE event_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'partial' END AS outcome, ts AS created
    FROM events
"""
