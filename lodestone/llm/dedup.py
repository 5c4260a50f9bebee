"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of bytes.  Equal blocks get equal
integer names by sorting them; adjacent names are then paired and the pairs
named in the same way, until each text has a single name.  Names come from
comparing the blocks and pairs themselves, so two texts have the same name, made
in the same number of rounds, exactly when they are equal: no hash decides.

Each task first finds the distinct blocks among its own rows and sends only
those to be sorted, so a block that a third of all rows share reaches the
sorting task once for each task that has it.  Sorting is done in hash buckets;
a name is the bucket's number and the rank in it, the same whenever it runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import scratch
from lodestone.llm.arrow import slices

#: Bytes of a block.
BLOCK = 1024
#: Bytes of items in a hash bucket, in which they are sorted and ranked, about, and buckets at least; a name is bucket << 40 | rank.
BUCKET, BUCKETS = 64 << 20, 1 << 14
#: Bytes of distinct blocks a task remembers before it starts anew (it then sends a block again, which costs only bytes).
REMEMBERED = 32 << 20
ITEM = "row long, pos int, of_row long, of_pos int, item binary, doc_id long, digest string"


def normalise(text: pa.Array) -> pa.Array:
    """A-Z in lower case, null as empty; other letters stay as they are."""
    return pc.ascii_lower(pc.fill_null(text, "")).cast(pa.binary())


class Local:
    """The distinct items of one task: each item's place where it first stood."""

    def __init__(self) -> None:
        self.seen: dict[bytes, tuple[int, int]] = {}
        self.bytes = 0
        self.out: list[tuple] = []

    def add(self, row: int, pos: int, item: bytes, *also: int | str | None) -> None:
        at = self.seen.get(item)
        if at is None:
            if self.bytes > REMEMBERED:
                self.seen, self.bytes = {}, 0
            self.seen[item] = (row, pos)
            self.bytes += len(item) + 100
            self.out.append((row, pos, row, pos, item, *also))
        else:
            self.out.append((row, pos, *at, None, *also))

    def take(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string()]
        cols = zip(*self.out, strict=True) if self.out else [()] * 7
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["row", "pos", "of_row", "of_pos", "item", "doc_id", "digest"])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of round 0: the blocks of each text; an empty text has one empty block."""
    local = Local()
    for batch in batches:
        for part in slices(batch, "text"):
            for row, doc, text in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), normalise(part.column("text")).to_pylist(), strict=True):
                local.add(row, 0, text[:BLOCK], doc, hashlib.sha256(text).hexdigest())
                for pos in range(1, -(-len(text) // BLOCK)):
                    local.add(row, pos, text[BLOCK * pos : BLOCK * (pos + 1)], None, None)
            yield local.take()


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of later rounds: adjacent names of a row, as 16 bytes; a last name without a partner is paired with -1."""
    local = Local()
    for batch in batches:
        for row, names in zip(batch.column("row").to_pylist(), batch.column("names").to_pylist(), strict=True):
            both = np.array(names + [-1] * (len(names) % 2), ">i8").tobytes()
            for pos in range(len(both) // 16):
                local.add(row, pos, both[16 * pos : 16 * pos + 16], None, None)
        yield local.take()


def named(items: DataFrame) -> DataFrame:
    """row and names (array of long, by position) from a written table of items."""
    total = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("item"), F.lit(max(BUCKETS, min(total // BUCKET, (1 << 22) - 1)))).cast("long")
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("item"))
    own = items.filter("item is not null").select("row", "pos", bucket.alias("bucket"), "item")
    # each item at its first place in a task, with its name
    first = own.select("row", "pos", (F.shiftleft(F.col("bucket"), 40) + rank).alias("name"))
    like = items.filter("item is null").select("row", "pos", "of_row", "of_pos")
    names = first.withColumnsRenamed({"row": "of_row", "pos": "of_pos"})
    rest = like.join(names, ["of_row", "of_pos"]).select("row", "pos", "name")
    return first.unionByName(rest).groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))


def identities(items: DataFrame) -> DataFrame:
    """row and identity (level, name), equal exactly for equal normalised texts, from the written items of round 0.

    There are as many further rounds as doublings of BLOCK in the longest text;
    only texts not yet down to one name take part in them.
    """
    out, level, last = None, 0, None
    while True:
        names = scratch.keep(named(items), "names")
        if last is not None:
            scratch.drop(last)
        ended = names.filter(F.size("names") == 1).select("row", F.lit(level).alias("level"), F.col("names")[0].alias("name"))
        out = ended if out is None else out.unionByName(ended)
        more = names.filter(F.size("names") > 1)
        if more.isEmpty():
            return out
        level += 1
        items = last = scratch.keep(more.mapInArrow(pairs, ITEM), "pairs")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Which of equal texts stays.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest doc_id stays (a null doc_id is the
    smallest; of rows with the same doc_id and text one stays).  Returns doc_id,
    keep_id, group_size, kept and digest (SHA-256 of the normalised text, in
    hexadecimal): one row for each row of ``docs``, dropped ones too.  An empty
    table gives no rows.  Other columns of ``docs`` are not read.
    """
    return decide(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")).drop("row")


def decide(numbered: DataFrame) -> DataFrame:
    """exact_duplicates() for rows that carry a number of their own in the column row, which is returned too."""
    rows = numbered.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch.small_batches(rows.sparkSession):
        items = scratch.keep(rows.mapInArrow(blocks, ITEM), "blocks")
    meta = items.filter("digest is not null").select("row", "doc_id", "digest")
    own = scratch.keep(identities(items).join(meta, "row"), "identities")
    scratch.drop(items)
    best = F.max(F.struct(F.col("doc_id"), (-F.col("row")).alias("turned"))).alias("best")
    groups = own.groupBy("level", "name").agg(F.count("*").alias("group_size"), best)
    # written, so that both sides of the join are shuffled for it and a large group of copies can be split
    groups = scratch.keep(groups.select("level", "name", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.turned")).alias("keep_row")), "groups")
    out = own.join(groups, ["level", "name"])
    return out.select("row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    number = "_row"
    while number in docs.columns:
        number += "_"
    rows = scratch.keep(docs.withColumn(number, F.monotonically_increasing_id()), "rows", "zstd")
    kept = decide(rows.select(F.col(number).alias("row"), "doc_id", "text")).filter("kept").select(F.col("row").alias(number))
    return rows.join(kept, number, "left_semi").drop(number)
