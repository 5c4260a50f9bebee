"""Best-fit packing planned over counts of lengths.

Documents are tokenised once into pieces of at most ``capacity`` tokens and
written to the shared folder.  Their lengths are counted (at most ``capacity``
counts reach the driver), best-fit decreasing is run on the counts: equal bins
are handled as one group, so a step costs as much for a billion documents as
for one.  Then every piece takes the planned slot of its rank among the pieces
of its length.  Ranks are dealt in sub-groups of a length, so a length that
many pieces share doesn't meet in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import scratch
from lodestone.llm.arrow import slices
from lodestone.llm.bpe import codec

#: Most sub-groups in which ranks are counted; the driver and each task hold one number for each.
SUBGROUPS = 100_000


@dataclass
class Plan:
    """Slots for each length. Parallel lists: the first rank, bins from ``bin0`` on, so many pieces in each, at ``offset``."""

    bins: int = 0
    slots: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over ``counts`` (length to number of pieces).

    A group is (first bin, bins) of equal content, filed under its free space;
    there are at most three new groups for each length.
    """
    out, free, levels = Plan(), {}, []

    def file(space: int, start: int, n: int) -> None:
        if space and n:
            if space not in free:
                free[space] = []
                levels.insert(bisect_left(levels, space), space)
            free[space].append((start, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        left, rank, slots = counts[length], 0, out.slots.setdefault(length, [])

        def fill(start: int, n: int, space: int) -> None:
            """Put what is left into n bins with this free space: each takes as many as fit before the next is begun."""
            nonlocal left, rank
            each = space // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            for first, bins, pieces in ((start, full, each), (start + full, 1, rest)):
                if bins and pieces:
                    slots.append((rank, first, pieces, capacity - space))
                    file(space - pieces * length, first, bins)
                    rank, left = rank + bins * pieces, left - bins * pieces
            used = full + (rest > 0)
            file(space, start + used, n - used)

        while left:
            at = bisect_left(levels, length)
            if at < len(levels):
                space = levels[at]
                start, n = free[space].pop()
                if not free[space]:
                    del free[space], levels[at]
            else:
                n = -(-left // (capacity // length))
                start, space = out.bins, capacity
                out.bins += n
            fill(start, n, space)
    return out


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document, cut only where it is longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = codec(path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), tool.encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return scratch.arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row for each piece: doc_id, piece (from 0), start (the
    document's ids before it), length, ids_crc32 (of its ids as little-endian
    32-bit integers), sequence_id, offset (place in the sequence).  Every
    document ends with ``end_id``, so null and empty texts are one piece of
    length 1.  Rows with a null or repeated doc_id are packed like any other.
    An empty table gives no rows.  Only doc_id and text are read.
    """
    made = scratch.keep(pieces(docs, path, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    planned = plan(counts, capacity)
    size = max(20_000, -(-sum(counts.values()) // SUBGROUPS))
    per = np.ones(capacity + 1, np.int64)
    for length, n in counts.items():
        per[length] = -(-n // size)
    first = np.r_[0, np.cumsum(per)]  # sub-group number of a length's first sub-group
    groups = F.lit(1).cast("long")
    if many := {length: int(p) for length, p in enumerate(per) if p > 1}:
        groups = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in many.items() for x in kv]), F.col("length")), groups)
    dealt = made.withColumn("sub", F.pmod(F.xxhash64("row"), groups))
    base = np.zeros(first[-1], np.int64)
    for r in dealt.groupBy("length", "sub").agg(F.count("*").alias("n")).collect():  # at most SUBGROUPS + capacity rows
        base[first[r.length] + r.sub] = r.n
    for length in counts:
        own = base[first[length] : first[length + 1]]
        own[:] = np.cumsum(own) - own
    slots = {length: np.array(s, np.int64) for length, s in planned.slots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, sub, at = (batch.column(c).to_numpy() for c in ("length", "sub", "at"))
            rank = base[first[length] + sub] + at - 1
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    n = int(length[own[0]])
                    got = slots[n][np.searchsorted(slots[n][:, 0], rank[own], side="right") - 1]
                    k = rank[own] - got[:, 0]
                    sequence[own], offset[own] = got[:, 1] + k // got[:, 2], got[:, 3] + k % got[:, 2] * n
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = dealt.withColumn("at", F.row_number().over(Window.partitionBy("length", "sub").orderBy("row")).cast("long")).drop("row")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
