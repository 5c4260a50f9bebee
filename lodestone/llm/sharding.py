"""Sharding by longest processing time: whole groups, sorted by size, each to the least-loaded shard, through a heap.

Documents of equal text are a group.  Groups of one size are alike to the heap, so
it works on a histogram: how many groups there are of each size, the largest size first.  A run of
many groups of one size is dealt in one step that ends in the same loads as one group after
the other.  The groups then take their planned places by joining on their rank within their size.

The histogram has a row for each size that occurs.  As these sizes are different and sum up to no more than all
bytes, there are at most the square root of twice the bytes: 15 million for 100 TB.  The driver holds it and the plan
in arrays: 16 bytes a size, 8 for where its list of shards begins, and 12 for each shard that gets some of its groups.
"""

from __future__ import annotations

import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import scratch

#: Parts of a shard, and of the groups of one size, in which rows are numbered.
PARTS = 512


def longest_first(sizes: np.ndarray, counts: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which shards the ``counts`` groups of each size go to, sizes in falling order.

    Each group goes to the shard with the least load (ties: the lower shard).  Returns where each size's part of the
    other two arrays begins (and the last one ends), the shards that get some of its groups, by number, and how many
    of its groups have been dealt with each of them.
    """
    loads = np.zeros(shards, np.int64)
    heap = [(0, k) for k in range(shards)]
    where, ends, begins = array("i"), array("q"), array("q", [0])
    for size, n in zip(map(int, sizes), map(int, counts), strict=True):  # a number at a time: no lists of them
        if n <= 4 * shards:
            own: dict[int, int] = {}
            for _ in range(n):
                load, k = heap[0]
                own[k] = own.get(k, 0) + 1
                heapq.heapreplace(heap, (load + size, k))
        else:
            for load, k in heap:
                loads[k] = load
            # a shard takes its next group at the load it has then; the n least (load, shard) of all are taken
            low, high = int(loads.min()), int(loads.min()) + size * n
            while low < high:  # the largest level under which no more than n groups are taken
                level = (low + high + 1) // 2
                if int((-((loads - level) // size)).clip(0).sum()) <= n:
                    low = level
                else:
                    high = level - 1
            taken = (-((loads - low) // size)).clip(0)
            at = np.flatnonzero((loads + taken * size) == low)[: n - int(taken.sum())]
            taken[at] += 1
            loads += taken * size
            heap = [(x, k) for k, x in enumerate(loads.tolist())]
            heapq.heapify(heap)
            own = {k: x for k, x in enumerate(taken.tolist()) if x}
        dealt = 0
        for k in sorted(own):
            dealt += own[k]
            where.append(k)
            ends.append(dealt)
        begins.append(len(where))
    return np.frombuffer(begins, np.int64), np.frombuffer(where, np.int32) if where else np.zeros(0, np.int32), np.frombuffer(ends, np.int64) if ends else np.zeros(0, np.int64)


def planned(sizes: np.ndarray, counts: np.ndarray, shards: int) -> pa.Table:
    """bytes, ends and shards: longest_first() with a row for each size."""
    begins, where, ends = longest_first(sizes, counts, shards)
    cut = lambda x: pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(x))
    return pa.table([pa.array(sizes), cut(ends), cut(where)], ["bytes", "ends", "shards"])


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Put every document into a shard so that bytes come out even.

    Documents of equal text stay together (a null text counts as empty).  Size:
    UTF-8 bytes of the text plus 16.  Returns doc_id, size, text_crc32, shard,
    slot (from 0 without gaps in each shard, in an order fixed by hash, then
    doc_id), one row for each row of ``docs``; rows with a null or repeated
    doc_id are placed like any other.  A group larger than a mean shard makes
    its shard larger: groups are never split.  An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("own"),
    )
    # written, so that all that follows counts and places the same groups
    groups = scratch.keep(rows.groupBy("own").agg(F.sum("size").alias("bytes")).withColumn("sub", F.pmod(F.xxhash64("own"), F.lit(PARTS)).cast("int")), "groups")
    parts = scratch.keep(groups.groupBy("bytes", "sub").agg(F.count("*").alias("n")), "parts")
    found = parts.groupBy("bytes").agg(F.sum("n").alias("n")).toArrow()  # a row for each size: see above
    order = np.argsort(-found["bytes"].to_numpy(), kind="stable")
    plan = planned(found["bytes"].to_numpy()[order], found["n"].to_numpy()[order], shards)
    before = Window.partitionBy("bytes").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows at most
    starts = parts.select("bytes", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")).join(spark.createDataFrame(plan), "bytes")
    rank = F.col("first") + F.row_number().over(Window.partitionBy("bytes", "sub").orderBy("own"))
    placed = groups.join(starts, ["bytes", "sub"]).withColumn("rank", rank)
    placed = placed.select("own", F.col("shards")[F.size(F.filter("ends", lambda e: e < F.col("rank")))].alias("shard"))
    dealt = scratch.keep(rows.join(placed, "own").withColumn("part", F.pmod(F.xxhash64("doc_id", "own"), F.lit(PARTS)).cast("int")), "dealt")
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))  # at most shards * PARTS rows
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "own"))
    out = dealt.withColumn("at", at).join(F.broadcast(firsts), ["shard", "part"])  # at most shards * PARTS rows
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at") - 1).cast("long").alias("slot"))
