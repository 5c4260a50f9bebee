"""Retrieval: BM25, cosine neighbours, keyword scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.functions.vectors import cosine
from lodestone.operators import patterns
from lodestone.operators.ranking import ranked
from lodestone.sources.versions import new_folder, written


def bm25(docs: DataFrame, query: list[str], key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 (Robertson and Zaragoza, 2009) of the documents that have one of the query's terms.

    Only the query's terms leave the scan: a document is one row with its length
    and its counts of them, whatever its text's length.
    """
    terms = list(dict.fromkeys(query))

    def times(term: str) -> Column:
        return F.size(F.filter("words", lambda w: w == term))

    words = docs.select(key, tokens(text).alias("words"))
    counted = words.select(key, F.size("words").alias("n"), *[times(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    counted = written(counted, new_folder(docs.sparkSession, "counts"))  # a few numbers a document; texts are split once
    stats = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hit = counted.filter(" OR ".join(f"tf{i} > 0" for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return hit.crossJoin(F.broadcast(stats)).select(key, score.alias("score"))  # stats: one row


def neighbours(vectors: DataFrame, asked: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Cosine of every vector with the first vector of ``asked`` (smallest key); no rows where there is none."""
    one = asked.filter(F.col(vector).isNotNull()).agg(F.min_by(vector, key).alias("_asked"))  # one row
    return vectors.crossJoin(F.broadcast(one)).filter("_asked IS NOT NULL").select(key, cosine(F.col(vector), F.col("_asked")).alias("score"))


def keyword_score(rows: DataFrame, words: list[str], weights: dict[str, int], key: str) -> DataFrame:
    """Sum of the weights of the columns in which each word occurs; rows without a hit are left out."""
    score = F.lit(0)
    for column, weight in weights.items():
        low = F.lower(F.coalesce(F.col(column), F.lit("")))
        for word in words:
            score = score + F.when(low.contains(word.lower()), weight).otherwise(0)
    return rows.select(key, score.alias("score")).filter("score > 0")


def containing(docs: DataFrame, passages: DataFrame, key: str, passage_key: str) -> DataFrame:
    """Pairs of passage_key and key: documents (key, text) that hold a passage (passage_key, passage), upper and lower case told apart.

    All passages are sought in one pass over the texts; see patterns.find(). Null texts and passages are in no pair, an
    empty passage is in every text.
    """
    return patterns.find(docs, passages, key, passage_key, pattern="passage", once=True).select(passage_key, key).distinct()


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", rows: int = 4096) -> DataFrame:
    """query, rank, key and score (cosine to six digits, 0 where a vector has no length) of the k best other vectors of each query.

    Blocks of queries meet blocks of vectors, each pair of blocks in a task of its own, as one product of
    matrices; of each pair only the k best a query go on. Ties go to the smaller key. Vectors that are null or hold a null,
    and vectors of another number of components than the query, take no part; repeated keys are rows of their own.
    """
    usable = F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull())
    v, q = (t.filter(usable).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x")).withColumn("dim", F.size("x")) for t in (vectors, queries))
    v_blocks, q_blocks = (max(1, -(-t.count() // rows)) for t in (v, q))
    places = F.sequence(F.lit(0), F.lit(q_blocks - 1)), F.sequence(F.lit(0), F.lit(v_blocks - 1))
    every = v.select("dim", "id", "x", F.lit(False).alias("asks"), F.pmod(F.xxhash64("id"), F.lit(v_blocks)).cast("int").alias("j"), F.explode(places[0]).alias("i"))
    asked = q.select("dim", "id", "x", F.lit(True).alias("asks"), F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("i"), F.explode(places[1]).alias("j"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for asks in (True, False):
            own = pdf[pdf["asks"] == asks]
            x = np.array(own["x"].tolist(), np.float64).reshape(len(own), int(pdf["dim"].iloc[0]))
            length = np.sqrt((x * x).sum(1, keepdims=True))
            sides.append((own["id"].to_numpy(), np.divide(x, length, out=np.zeros_like(x), where=length > 0)))
        (qid, qx), (vid, vx) = sides
        score = np.round(qx @ vx.T, 6)
        found = []
        for i, own in zip(qid, score, strict=True):
            order = np.lexsort((vid, -own))
            order = order[vid[order] != i][:k]
            found.append(pd.DataFrame({"query": i, key: vid[order], "score": own[order]}))
        return pd.concat(found) if found else pd.DataFrame({"query": [], key: [], "score": []})

    met = every.unionByName(asked).groupBy("dim", "i", "j").applyInPandas(best, f"query long, {key} long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), key))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", key, "score")


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """An index of all terms: term, key, tf and n (terms of the document). Documents without a term have no row."""
    words = docs.select(key, tokens(text).alias("words"))
    return words.select(key, F.size("words").alias("n"), F.explode("words").alias("term")).groupBy("term", key, "n").agg(F.count("*").alias("tf"))


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Keep the index of ``docs``: postings sorted by term, so that a search reads few of its row groups, and one row of document counts."""
    index = postings(docs, key, text)
    index.repartitionByRange("term", key).sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{path}/postings")
    docs.select(F.size(tokens(text)).alias("n")).agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).write.mode("overwrite").parquet(f"{path}/sizes")


def search_index(index: DataFrame, sizes: DataFrame, query: list[str], k: int, keep: DataFrame | None = None, key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score and rank of the k best documents by BM25 over an index (postings) and its sizes (docs, mean: one row).

    The terms' statistics are those of all documents; ``keep`` (keys) then says which of them are ranked.
    """
    hit = index.filter(F.col("term").isin(query))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))  # a row for each of the query's terms
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    each = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    if keep is not None:
        hit = hit.join(keep.select(key), key, "left_semi")
    scores = hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(sizes)).groupBy(key).agg(F.round(F.sum(each), 6).alias("score"))
    return ranked(scores, key, F.col("score"), k)


def new_postings(index: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings to append to an index: those of documents that have none in it yet."""
    return postings(docs.join(index.select(key).distinct(), key, "left_anti"), key, text)
