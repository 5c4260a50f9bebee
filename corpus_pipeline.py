"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and is written as Parquet before the next one reads it.  All but the last return
the columns of ``documents``; columns that ``docs`` has besides them go through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import dedup, language, neardup, packing, scratch, suffixes

#: A document stays if its main language has this share of it.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn languages from the labelled documents; documents without a letter or without a main language go.

    ``lang`` becomes the predicted language.  Where no document has a lang, there is nothing to learn and all
    documents are rejected.
    """
    model = language.train(docs)
    found = language.predict(model, F.col("text").cast("string"))
    name = "_found"
    while name in docs.columns:
        name += "_"
    good = docs.withColumn(name, found).filter((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= LEAST_SHARE))
    return good.withColumn("lang", F.col(f"{name}.lang_pred")).drop(name)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z's case, the one with the largest doc_id stays.

    Null and empty texts are equal, so one row of them stays; a null doc_id is the smallest, of rows with one doc_id and
    text one stays. Texts of any length are compared whole.
    """
    return dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (similarity 0.8 of shingles of five words), the one with the smallest doc_id stays.

    Texts without a word, null ones too, are like no other and stay; a null doc_id is larger than any. Texts of any length
    are compared whole; texts of fewer than five words are one shingle.
    """
    return neardup.deduplicate(docs, least=0.8)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a document with a smaller doc_id has are cut out; n_chars follows. No document goes.

    A null text becomes an empty one; a document without a doc_id loses nothing and takes nothing from others.
    """
    return suffixes.without_repeats(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; see packing.pack()."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit", best_fit),
]

#: No SQL: language mixtures, sketches and best-fit packing have none. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
