"""Exact top-k by inner product with norm buckets.

Vectors are grouped by length into buckets, the longest first, and stored as
blocks of a bounded number of rows.  The longest vectors of all give each query a first
threshold; queries with like needs share a block, and a block of vectors is sent to a
block of queries only if its longest vector is as long as the least of these needs.
A block of queries walks the blocks of a segment in falling order of length and keeps its k best so far.  The kth score divided by the
query's length and the bucket's longest length is a local cosine threshold: over
1, the whole bucket is pruned; else the bucket is pruned either by length (only
vectors long enough) or by the query's largest coordinate (only vectors whose
direction has that coordinate in the range the threshold allows), whichever
leaves fewer.  What is left is verified by exact integer products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import scratch

#: Rows of a block of vectors, rows of a block of queries, blocks of a segment.
VECTORS, QUERIES, SEGMENT = 4096, 2048, 8
#: Norm buckets at most; the driver holds one bound for each.
BUCKETS = 1000
#: Longest vectors from which every query takes its first threshold.
SEEDS = 1024
#: Slack that keeps rounding from pruning a vector at the threshold.
SLACK = 1e-9


def products(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where every sum stays below 2**53."""
    if not matrix.size:
        return np.zeros(len(matrix), np.int64)
    if float(np.abs(matrix).max()) * float(np.abs(vector).max() if vector.size else 0) * matrix.shape[1] < 2**53:
        return (matrix.astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
    return matrix @ vector


class Block:
    """Vectors of one bucket, the longest first."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        norms = np.sqrt((matrix.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.matrix, self.norms = ids[order], matrix[order], norms[order]
        self.fall = -self.norms
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Places by the f-th coordinate of the direction, and those coordinates in order."""
        if f not in self.sorted:
            value = self.matrix[:, f] / np.maximum(self.norms, 1e-300)
            order = np.argsort(value, kind="stable")
            self.sorted[f] = order, value[order]
        return self.sorted[f]

    def candidates(self, query: np.ndarray, length: float, least: float) -> np.ndarray | slice:
        """Places of all vectors whose product with the query can reach ``least``."""
        if least <= 0 or not length:
            return slice(None)
        long = int(np.searchsorted(self.fall, -(least / length) * (1 - SLACK), side="right"))
        cosine = least / (length * self.norms[0]) if self.norms[0] else 2.0
        cosine *= 1 - SLACK
        if cosine > 1 or not long:
            return slice(0, 0)
        f = int(np.abs(query).argmax())
        a, t = math.acos(max(-1.0, min(1.0, query[f] / length))), math.acos(cosine)
        low = math.cos(min(math.pi, a + t)) - SLACK
        high = math.cos(max(0.0, a - t)) + SLACK
        order, value = self.coordinate(f)
        i, j = np.searchsorted(value, low, side="left"), np.searchsorted(value, high, side="right")
        return slice(0, long) if long <= j - i else order[i:j]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(query_ids: np.ndarray, queries: np.ndarray, blocks: list[Block], seeds: Block | None, k: int) -> list[tuple]:
    """(query, vector, score) of each query's k best in these blocks, fewer where others are known to be better."""
    out = []
    lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    for qid, query, length in zip(query_ids.tolist(), queries, lengths.tolist(), strict=True):
        floor = -math.inf
        if seeds is not None:
            scores = products(seeds.matrix, query)[seeds.ids != qid]
            if len(scores) >= k:
                floor = float(np.partition(scores, len(scores) - k)[len(scores) - k])
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for block in blocks:
            least = max(floor, float(scores[-1]) if len(scores) == k else -math.inf)
            places = block.candidates(query, length, least)
            found = block.ids[places]
            if len(found):
                got = products(block.matrix[places], query)
                take = (found != qid) & (got >= least)
                ids, scores = best(np.r_[ids, found[take]], np.r_[scores, got[take]], k)
        out.extend((qid, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True))
    return out


def needs(matrix: np.ndarray, ids: np.ndarray, seeds: Block | None, k: int) -> np.ndarray:
    """Of each query: the length under which a vector can't be among its k best; 0 if any can."""
    out = np.zeros(len(ids))
    for i in range(len(ids) if seeds is not None else 0):
        scores = products(seeds.matrix, matrix[i])[seeds.ids != ids[i]]
        length = math.sqrt(float((matrix[i].astype(np.float64) ** 2).sum()))
        if len(scores) >= k and length:
            out[i] = max(0.0, float(np.partition(scores, len(scores) - k)[len(scores) - k]) / length * (1 - SLACK))
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row with all vectors of a group, sorted by id, the longest one's length and the least need."""
    pdf = pdf.sort_values("vec_id", kind="stable")
    matrix = np.array(pdf["vector"].tolist(), np.int64).reshape(len(pdf), int(pdf["dim"].iloc[0]))
    row = {"dim": int(pdf["dim"].iloc[0]), "block": int(pdf["block"].iloc[0]), "top": float(pdf["norm"].max()), "need": float(pdf["need"].min()), "n": len(pdf), "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "data": matrix.tobytes()}
    return pd.DataFrame([row])


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.data, np.int64).reshape(row.n, row.dim)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """For each row of ``queries`` its ``k`` best rows of ``vectors`` by inner product.

    Both have vec_id (long) and vector (array of long).  Candidates are all rows
    with another vec_id and as many components.  Returns query_id, rank (from
    1), vec_id, score; ties go to the smaller vec_id, and all candidates come
    where there are fewer than ``k``.  Rows with a null id, a null vector or a
    null component take no part; a query id that occurs several times asks once, with the least of its vectors (component by
    component), and each row of a repeated vector id is a candidate.  Products must fit
    a long.  Empty tables give no rows.
    """
    spark = vectors.sparkSession
    usable = "vec_id is not null and vector is not null and not exists(vector, x -> x is null)"

    def shape(frame: DataFrame) -> DataFrame:
        return frame.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<long>").alias("vector")).filter(usable).withColumn("dim", F.size("vector"))

    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    asked = shape(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    everything = shape(vectors).withColumn("norm", norm)
    n, n_queries = everything.count(), asked.count()
    seeds = everything.orderBy(F.col("norm").desc(), "vec_id").limit(SEEDS).select("dim", "vec_id", "vector").toPandas()  # at most SEEDS rows
    first = {d: Block(g["vec_id"].to_numpy(np.int64), np.array(g["vector"].tolist(), np.int64).reshape(len(g), d)) for d, g in seeds.groupby("dim")}
    buckets = min(BUCKETS, max(1, n // VECTORS))
    cuts = sorted(set(everything.approxQuantile("norm", [i / buckets for i in range(1, buckets)], 0.1 / buckets))) if buckets > 1 else []
    bucket = F.lit(0) if not cuts else F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("norm")))
    dealt = everything.withColumn("bucket", bucket)
    sizes = {r.bucket: r.n for r in dealt.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # at most BUCKETS rows
    start, total = {}, 0
    for b in sorted(sizes):
        start[b], total = total, total + -(-sizes[b] // VECTORS)
    if not total or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def pick(values: dict[int, int]):
        return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("bucket"))

    parts = pick({b: -(-sizes[b] // VECTORS) for b in sizes})
    block = pick(start) + F.pmod(F.xxhash64("vec_id", "vector"), parts).cast("int")
    packed = "dim int, block int, top double, need double, n int, ids binary, data binary"
    # both written: their small columns say which blocks meet before their vectors are sent
    v = dealt.withColumn("block", block).select("dim", "block", "norm", F.lit(0.0).alias("need"), "vec_id", "vector")
    v = scratch.keep(v.groupBy("dim", "block").applyInPandas(_pack, packed), "vectors")

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for dim, own in pdf.groupby("dim"):
                matrix = np.array(own["vector"].tolist(), np.int64).reshape(len(own), int(dim))
                yield own.assign(need=needs(matrix, own["vec_id"].to_numpy(np.int64), first.get(int(dim)), k))

    wanted = scratch.keep(asked.select("vec_id", "vector", "dim", F.lit(0.0).alias("need")).mapInPandas(ask, "vec_id long, vector array<long>, dim int, need double"), "queries")
    q_blocks = -(-n_queries // QUERIES)
    # by need as far as blocks of two needs go, by hash within one
    groups = min(BUCKETS, q_blocks)
    steps = sorted(set(wanted.approxQuantile("need", [i / groups for i in range(1, groups)], 0.1 / groups))) if groups > 1 else []
    step = F.lit(0) if not steps else F.size(F.filter(F.array(*map(F.lit, steps)), lambda c: c < F.col("need")))
    each = -(-q_blocks // (len(steps) + 1))
    q_block = step * each + F.pmod(F.xxhash64("vec_id"), F.lit(each)).cast("int")
    q = wanted.select("dim", q_block.alias("block"), F.lit(0.0).alias("norm"), "need", "vec_id", "vector").groupBy("dim", "block").applyInPandas(_pack, packed)
    q = scratch.keep(q.select("dim", F.col("block").alias("q_block"), "need", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "asked")
    places = v.select("dim", "block", "top", F.explode(F.sequence(F.lit(0), F.lit(each * (len(steps) + 1) - 1))).alias("q_block"))
    met = places.join(q.select("dim", "q_block", "need"), ["dim", "q_block"]).filter("top >= need").select("dim", "block", "q_block")
    grid = met.join(v.drop("top", "need"), ["dim", "block"]).join(q.drop("need"), ["dim", "q_block"]).withColumn("segment", F.floor(F.col("block") / SEGMENT))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("block").itertuples())
        dim = int(rows[0].dim)
        ids = np.frombuffer(rows[0].q_ids, np.int64)
        asked_for = np.frombuffer(rows[0].q_data, np.int64).reshape(rows[0].q_n, dim)
        found = search(ids, asked_for, [Block(*_unpack(r)) for r in rows], first.get(dim), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = grid.groupBy("dim", "q_block", "segment").applyInPandas(walk, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
