"""Near-duplicates by order MinHash, verified by banded alignment.

A text's words make shingles of five, each labelled with how often it occurred before.  A
sketch takes the few labelled shingles with the least hash and keeps them in
text order; texts share a sketch with a probability that falls with their edit
distance.  Texts with the same words are one class from the start and take part once.

Texts that share a sketch are a bucket.  A bucket's centre is the text that meets most others in all of
its buckets: an original meets its copies in more of them than copies meet each other, so most of a
group of copies are linked by one comparison each.  Then the texts of a bucket that are still under
different labels are held against each other, in blocks: sizes and parities (one bit for each of many
classes of labels) rule out nearly all pairs that are not alike, and none that is, and what is left is
aligned.  Blocks of a bucket are as many as the square of its rows, so the texts of a bucket with thousands under
different labels meet by their rarest labelled shingles instead, one of which alike texts share.  Aligning compares the two shingle sequences
inside a band as wide as the similarity allows.

Texts of few shingles, which may be alike and share no sketch, share their buckets by their rarest
labelled shingles too, so that no pair of them is missed.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import scratch
from lodestone.llm.arrow import lists, slices

#: Words of a shingle, shingles of a sketch, sketches of a text.
WORDS, SAMPLE, SKETCHES = 5, 5, 32
#: Labelled shingles of a text up to which all pairs that may be alike are compared, whether they share a sketch or not.
SHORT = 64
#: Rows of a bucket outside its largest label from which on they meet by their rarest labelled shingles instead.
CROWD = 2048
#: Rows of a block in which pairs of a bucket are sought, about, bits of a text's parities, and pairs whose parities are held against each other at once.
BLOCK, PARITY, AT_ONCE = 1024, 1024, 1 << 16
#: Bytes of text that are hashed at once; bytes of labels that an aligning task remembers.
PIECE, ALIGNED = 1 << 20, 32 << 20
_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


#: Odd multipliers, one for each sketch: labels are mixed already, so a product's leading bits order them anew.
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _M) | np.uint64(1)
#: A number for each byte.
_BYTES = mix(np.arange(1000, 1256, dtype=np.uint64) * _M)
#: Labels under a sketch's cut, about: enough that a sketch finds SAMPLE of them all but always.
SIFTED = 24


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of ``text``, whose words have one space between them: the sum of a number for each byte times a power for its place."""
    out = []
    while text:
        end = text.find(b" ", PIECE)
        piece, text = (text, b"") if end < 0 else (text[:end], text[end + 1 :])
        raw = np.frombuffer(piece + b" ", np.uint8)  # each word with the space behind it
        starts = np.r_[0, np.flatnonzero(raw == 32)[:-1] + 1]
        place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
        power = np.cumprod(np.full(int(place.max()) + 1, _M))
        out.append(np.add.reduceat(_BYTES[raw] * power[place], starts))
    return mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def labelled(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in text order, each with its occurrence number in its text, and the number of each text's.

    A text of fewer than five words is one shingle, one without words none.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n = np.where(sizes == 0, 0, np.maximum(1, sizes - WORDS + 1))
    h = np.r_[word_hashes(" ".join(chain.from_iterable(texts)).encode()), np.zeros(WORDS, np.uint64)]
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(sizes) - sizes, n)
    width = np.minimum(sizes, WORDS)[owner]
    x = width.astype(np.uint64)
    for k in range(WORDS):
        x = mix(x * _M + np.where(k < width, h[at + k], np.uint64(0)))
    # equal shingles of one text have equal keys; of two texts hardly ever, and the owner is compared too
    key = mix(x + owner.astype(np.uint64) * _M)
    order = np.argsort(key, kind="stable")
    s, o = key[order], owner[order]
    place = np.arange(len(x))
    start = np.maximum.accumulate(np.where(np.r_[True, (s[1:] != s[:-1]) | (o[1:] != o[:-1])][: len(x)], place, 0)) if len(x) else place
    seen = np.empty(len(x), np.uint64)
    seen[order] = (place - start).astype(np.uint64)
    return mix(x + seen * _M), n


def sketches(label: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row for each text, one number for each sketch: the least SAMPLE labels of the text in text order (all, if there are fewer)."""
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    # a sketch's least labels are sought among those under a cut that a text has about SIFTED of
    cut = np.array([(1 << 64) * SIFTED // n if n > SIFTED else (1 << 64) - 1 for n in sizes.tolist()], np.uint64)[owner]
    held = np.zeros((len(sizes), SKETCHES, SAMPLE), np.uint64)
    for k, seed in enumerate(_SEEDS):
        value = label * seed
        at = np.flatnonzero(value <= cut)
        by = owner[at]
        order = np.argsort(by.astype(np.uint64) << np.uint64(40) | value[at] >> np.uint64(24), kind="stable")
        many = np.bincount(by, minlength=len(sizes))
        rank = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        least = np.sort(at[order[rank < SAMPLE]])
        by, many = owner[least], np.minimum(many, SAMPLE)
        held[by, k, np.arange(len(least)) - np.repeat(np.cumsum(many) - many, many)] = label[least]
        for i in np.flatnonzero(many < np.minimum(sizes, SAMPLE)).tolist():
            a, b = starts[i], starts[i] + sizes[i]
            held[i, k] = label[a:b][np.sort(np.argsort(value[a:b] >> np.uint64(24), kind="stable")[:SAMPLE])]
    code = np.broadcast_to(_SEEDS, held.shape[:2])
    for c in range(SAMPLE):
        code = mix(code * _M + held[:, :, c])
    return code


def parities(label: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text and each of PARITY values of a label's last bits, whether an odd number of its labels has it, as bytes."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    held, many = np.unique(owner * PARITY + (label % np.uint64(PARITY)).astype(np.int64), return_counts=True)
    odd = np.zeros(len(sizes) * PARITY, np.uint8)
    odd[held] = many & 1
    return np.packbits(odd.reshape(-1, PARITY), axis=1)


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Aligned shingles over all shingles of both, or 0 if that is under ``least``.

    The alignment is the longest chain of equal labelled shingles, in order in
    both texts, whose places differ by no more than similarity ``least`` allows.
    """
    return aligned(a, b, np.argsort(b, kind="stable"), least)


def aligned(a: np.ndarray, b: np.ndarray, bt: np.ndarray, least: float) -> float:
    """similarity(), where ``bt`` is the order of ``b``."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    # chain / (n + m - chain) >= least leaves n + m - 2 * chain insertions and deletions at most
    band = int((n + m) * (1 - least) / (1 + least)) + 1
    place = np.minimum(np.searchsorted(b[bt], a), m - 1)
    hit = b[bt][place] == a
    i, j = np.flatnonzero(hit), bt[place[hit]]
    near = np.abs(i - j) <= band
    j = j[near]
    if len(j) < least * (n + m) / (1 + least) - 1e-9:
        return 0.0
    if len(j) > 1 and not (np.diff(j) > 0).all():
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        chain = len(tails)
    else:
        chain = len(j)
    got = chain / (n + m - chain)
    return got if got >= least - 1e-12 else 0.0


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _prepare(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows with their sketches and parities, those of at most ``most`` labelled shingles with their labels too."""
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            row, text = part.column("row"), part.column("text").to_pylist()
            words = [words_of(t or "") for t in text]
            # a text without words is like no other
            sig = [hashlib.sha256(" ".join(own).encode()).digest() if own else b"row %d" % r for r, own in zip(row.to_pylist(), words, strict=True)]
            label, sizes = labelled(words)
            few = (sizes <= most) & (sizes > 0)
            short = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes * few)].astype(np.int32)), pa.array(label[np.repeat(few, sizes)].view(np.int64)))
            parity = [bytes(p) for p in parities(label, sizes)]
            flat = pa.array(sketches(label, sizes)[sizes > 0].astype(np.int64).ravel())
            offsets = pa.array(np.r_[0, np.cumsum((sizes > 0) * SKETCHES)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([row, part.column("doc_id"), part.column("text"), pa.array(sig, pa.binary()), pa.array(np.maximum(sizes, 1)), pa.ListArray.from_arrays(offsets, flat), pa.array(parity, pa.binary()), short], ["row", "doc_id", "text", "sig", "size", "sketch", "parity", "label"])


def components(links: DataFrame) -> DataFrame:
    """row and component (its least row) of all rows in ``links`` (a, b), written, by least labels and pointer jumping."""
    edges = scratch.keep(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = scratch.keep(edges.groupBy(F.col("a").alias("row")).agg(F.min("b").alias("least")).select("row", F.least("row", "least").alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("row").alias("b"), "component"), "b").groupBy(F.col("a").alias("row")).agg(F.min("component").alias("near"))
        step = scratch.keep(labels.join(near, "row").select("row", F.col("component").alias("was"), F.least("component", "near").alias("component")), "step")
        # a component's number is a row of it, so it has a label itself
        jump = step.select(F.col("row").alias("component"), F.col("component").alias("further"))
        new = scratch.keep(step.join(jump, "component").select("row", F.least("component", "further").alias("component"), "was"), "labels")
        changed = not new.filter("component <> was").isEmpty()
        scratch.drop(labels, step)
        labels = new
        if not changed:
            scratch.drop(edges)
            return labels.drop("was")


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (row, centre) whose texts have at least this similarity.

    Merge joins at every size, so that Spark splits a centre with very many rows over several tasks (adaptive skew
    joins) and never broadcasts texts for looking small when compressed.
    """
    other = texts.select(F.col("row").alias("centre"), F.col("text").alias("to_text"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                a, b = part.column("row").to_pylist(), part.column("centre").to_pylist()
                if size > ALIGNED:
                    known, size = {}, 0
                wanted = dict(zip(b, part.column("to_text").to_pylist(), strict=True)) | dict(zip(a, part.column("text").to_pylist(), strict=True))
                new = [r for r in wanted if r not in known]
                label, sizes = labelled([words_of(wanted[r]) for r in new])
                for r, own in zip(new, np.split(label, np.cumsum(sizes)[:-1]), strict=True) if new else ():
                    known[r] = own, np.argsort(own, kind="stable")
                size += 2 * label.nbytes
                like = pa.array([aligned(known[x][0], *known[y], least) > 0 for x, y in zip(a, b, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("centre")], ["a", "b"]).filter(like)

    both = pairs.join(texts.hint("merge"), "row").join(other.hint("merge"), "centre")
    return scratch.arrow(both.select("row", "centre", "text", "to_text"), align, "a long, b long")


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The class of near-duplicates of every document.

    Words are runs without white space in lower case.  Two texts are linked if
    similarity() of their shingles of five words is ``least`` or more; classes are
    the components of the links.  Returns doc_id, class_id (the smallest doc_id of the
    class), class_size and kept (one row of a class: that with the smallest
    doc_id), one row for each row of ``docs``.  Rows with the same words are in
    one class; texts without a word, null ones too, are in a class of their own.
    A null doc_id counts as larger than any; a class of such rows has a null
    class_id.  An empty table gives no rows.  Other columns are not read.
    """
    return classes(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), least).drop("row")


def classes(numbered: DataFrame, least: float = 0.8, written: bool = False) -> DataFrame:
    """near_duplicates() for rows that carry a number of their own in the column row, which is returned too.

    Where ``numbered`` is a written table, whose rows keep their numbers, texts are read from it and not written again.
    """
    given = numbered.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    most = int(SHORT / least) + 1  # a text of at most SHORT labels is like none of more than that
    rows = scratch.arrow(given, lambda batches: _prepare(batches, most), "row long, doc_id long, text string, sig binary, size long, sketch array<long>, parity binary, label array<long>")
    rows = scratch.keep(rows.drop("text") if written else rows, "sketches", "zstd")
    same = scratch.keep(rows.groupBy("sig").agg(F.min("row").alias("rep")), "same")
    members = _members(rows.join(same.select(F.col("rep").alias("row")), "row", "left_semi"), least)
    texts = scratch.keep((given if written else rows).select("row", "text").join(members.select("row").distinct().hint("merge"), "row", "left_semi"), "candidates", "zstd")
    tested = scratch.keep(_stars(members), "stars")
    stars = scratch.keep(verify(tested, texts, least), "links")
    labels = scratch.keep(_labels(stars), "labels")
    own = scratch.keep(_labelled(members.select("sketch", "row"), labels), "labelled")
    pairs = _across(_spread(own, texts, least), rows.select("row", "size", "parity"), least)
    pairs = scratch.keep(pairs.join(tested, ["row", "centre"], "left_anti"), "pairs")
    scratch.drop(own)
    links = scratch.keep(stars.unionByName(verify(pairs, texts, least)), "links")
    scratch.drop(members, texts, tested, stars, pairs)
    # links between labels: most links are inside one
    ends = _labelled(_labelled(links.withColumnRenamed("a", "row"), labels).select(F.col("label").alias("a"), F.col("b").alias("row")), labels)
    between = components(ends.select("a", F.col("label").alias("b")).filter("a <> b").distinct())
    own = rows.select("row", "doc_id", "sig").join(same, "sig").join(labels.withColumnRenamed("row", "rep"), "rep", "left")
    own = own.withColumn("label", F.coalesce("label", "rep")).join(between.withColumnRenamed("row", "label"), "label", "left")
    own = scratch.keep(own.select("row", "doc_id", F.coalesce("component", "label").alias("component")), "own")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = scratch.keep(own.groupBy("component").agg(first, F.count("*").alias("class_size")).select("component", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("first_row"), "class_size"), "groups")
    scratch.drop(rows, same, labels, links)
    return own.join(groups, "component").select("row", "doc_id", "class_id", "class_size", (F.col("row") == F.col("first_row")).alias("kept"))


def _members(reps: DataFrame, least: float) -> DataFrame:
    """sketch, row and popularity of the members of buckets of two rows or more, written; a row's popularity is the sum of its buckets' sizes."""
    buckets = reps.select("row", F.explode("sketch").alias("sketch"))
    buckets = buckets.unionByName(_rarest(reps.select("row", "size", F.explode("label").alias("sketch")), least))
    several = scratch.keep(buckets.groupBy("sketch").agg(F.count("*").alias("n")).filter("n > 1"), "several")
    # a row has SKETCHES buckets, or a few more if it is short
    popularity = F.sum("n").over(Window.partitionBy("row"))
    # merge joins at every size: how many buckets there are grows with the corpus
    out = scratch.keep(buckets.join(several.hint("merge"), "sketch").select("sketch", "row", popularity.alias("popularity")), "members")
    scratch.drop(several)
    return out


def _stars(members: DataFrame) -> DataFrame:
    """row and centre: each row with the most popular row of its buckets, that of most buckets, if it isn't the most popular itself.

    Centres are more popular than their rows, or as popular and of a smaller number, so there are no circles.
    """
    rank = F.struct("popularity", (-F.col("row")).alias("turned"))
    centres = members.groupBy("sketch").agg(F.max(rank).alias("most")).select("sketch", (-F.col("most.turned")).alias("centre"))
    met = members.select("sketch", "row").join(centres, "sketch").filter("row <> centre").repartition("row")
    return met.groupBy("row", "centre").agg(F.count("*").alias("n")).groupBy("row").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("centre"))


def _labels(stars: DataFrame) -> DataFrame:
    """row and label of the linked rows: its centre's centre, or its centre if that has none.

    A label need not be a whole component: where it is less, more pairs are compared, none fewer.
    """
    further = stars.select(F.col("a").alias("b"), F.col("b").alias("further"))
    return stars.join(further, "b", "left").select(F.col("a").alias("row"), F.coalesce("further", "b").alias("label"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))


def _rarest(labels: DataFrame, least: float) -> DataFrame:
    """Of ``labels`` (row, size, sketch) of few labels each, those rarest ones of a row of which it shares one with every row that is ``least`` alike.

    Alike rows share ceil(least * size) labels or more, so one is among the size - ceil(least * size) + 1 first
    in any order that is the same for all rows.  Labels that only one row has come first and are not returned.
    """
    common = scratch.keep(labels.groupBy("sketch").agg(F.count("*").alias("n")).filter("n > 1"), "common")
    held = labels.join(common.hint("merge"), "sketch").groupBy("row", "size").agg(F.array_sort(F.collect_list(F.struct("n", "sketch"))).alias("held"))
    first = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1 - (F.col("size") - F.size("held"))
    return held.select("row", F.explode(F.slice("held", F.lit(1), F.greatest(first, F.lit(0)).cast("int")))).select("row", F.col("col.sketch").alias("sketch"))


def _spread(own: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``own`` (sketch, row, label) with the rows of crowded buckets dealt to buckets of their rarest labelled shingles.

    A bucket is crowded if it has more than CROWD rows outside its largest label.  Two of its rows that are alike share
    one of their rarest labelled shingles among those of all crowded buckets' rows; see _rarest().  There are as many of
    these a row as its size allows, however large the bucket was.
    """
    counts = own.groupBy("sketch", "label").agg(F.count("*").alias("n")).groupBy("sketch").agg((F.sum("n") - F.max("n")).alias("outer"))
    crowded = scratch.keep(counts.filter(F.col("outer") > CROWD).select("sketch"), "crowded")
    if crowded.isEmpty():
        return own

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                label, sizes = labelled([words_of(t or "") for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sizes), lists(label.view(np.int64), sizes)], ["row", "size", "label"])

    held = own.join(crowded.hint("merge"), "sketch", "left_semi").select("row", "label").distinct()
    spelt = scratch.arrow(texts.join(held.select("row").hint("merge"), "row", "left_semi").select("row", "text"), spell, "row long, size long, label array<long>")
    rare = _rarest(spelt.select("row", "size", F.explode("label").alias("sketch")), least)
    # written: the buckets are counted, then met
    dealt = scratch.keep(rare.join(held.hint("merge"), "row").select("sketch", "row", "label"), "spread")
    return own.join(crowded.hint("merge"), "sketch", "left_anti").unionByName(dealt)


def _across(own: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (row, centre) of a bucket's rows under different labels, without those whose sizes or parities show that they aren't ``least`` alike.

    ``own`` has sketch, row and label, ``texts`` row, size and parity.
    """
    dealt = _blocks(own, texts).repartition("block").sortWithinPartitions("block", "sketch", "i", "j", "probe")
    return scratch.arrow(dealt, lambda batches: _meet(batches, least), "row long, centre long").distinct()


def _blocks(own: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of the buckets, dealt to blocks: every row outside a bucket's largest label meets all rows of the bucket.

    A block is a part of the former and a part of the latter, of BLOCK rows or so each.
    """
    counts = own.groupBy("sketch", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("sketch").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).filter("most < n")
    outer, inner = F.ceil((F.col("n") - F.col("most")) / BLOCK), F.ceil(F.col("n") / BLOCK)
    mine, zero = F.xxhash64("row"), F.lit(0).cast("long")
    probe = F.transform(F.sequence(zero, inner - 1), lambda j: F.struct(F.pmod(mine, outer).alias("i"), j.alias("j"), F.lit(True).alias("probe")))
    every = F.transform(F.sequence(zero, outer - 1), lambda i: F.struct(i.alias("i"), F.pmod(mine, inner).alias("j"), F.lit(False).alias("probe")))
    places = F.when(F.col("label") == F.col("main"), every).otherwise(F.concat(probe, every))
    dealt = own.join(main, "sketch").join(texts.hint("merge"), "row").select("sketch", "row", "label", "size", "parity", F.explode(places).alias("at"))
    dealt = dealt.select(F.xxhash64("sketch", "at.i", "at.j").alias("block"), "sketch", "at.i", "at.j", "at.probe", "row", "label", "size", "parity")
    return dealt




def _meet(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The possible pairs of each block; batches are sorted by block, in each the rows that are met before those that meet them."""
    rest: list[pa.RecordBatch] = []

    def blocks(table: pa.Table, ended: bool) -> tuple[pa.Table, pa.RecordBatch]:
        """The rows of the last block, unless ``ended``, and the pairs of the blocks before it."""
        keys = np.stack([table[c].to_numpy() for c in ("sketch", "i", "j")])
        first = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
        end = table.num_rows if ended else int(first[-1])
        bounds = np.r_[first[first < end], end]
        row, label, size = (table[c].to_numpy() for c in ("row", "label", "size"))
        parity = np.frombuffer(b"".join(table["parity"].to_pylist()), np.uint64).reshape(-1, PARITY // 64)
        met = np.add.reduceat((~table["probe"].to_numpy()[:end]).astype(np.int64), bounds[:-1]) if end else np.zeros(0, np.int64)
        a, b = possible(bounds[:-1], met, np.diff(bounds) - met, size, label, parity, least)
        x, y = row[a], row[b]
        return table.slice(end), pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["row", "centre"])

    for batch in batches:
        if batch.num_rows:
            left, found = blocks(pa.Table.from_batches([*rest, batch]), ended=False)
            rest = left.combine_chunks().to_batches()
            yield found
    if rest:
        yield blocks(pa.Table.from_batches(rest), ended=True)[1]


def possible(first: np.ndarray, met: np.ndarray, probes: np.ndarray, size: np.ndarray, label: np.ndarray, parity: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different label that may be ``least`` alike, of blocks that begin at ``first`` and have ``met`` rows and then ``probes`` rows.

    A label that only one text has turns one bit of its parities, so at least as many labels differ as bits do.
    """
    ends = np.cumsum(met * probes)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for begin in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
        k = np.arange(begin, min(begin + AT_ONCE, int(ends[-1])))
        block = np.searchsorted(ends, k, side="right")
        k = k - (ends - met * probes)[block]
        a, b = first[block] + k % met[block], first[block] + met[block] + k // met[block]
        n, m = size[a], size[b]
        ok = (label[a] != label[b]) & (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9)
        a, b = a[ok], b[ok]
        most = (size[a] + size[b]) * ((1 - least) / (1 + least)) + 1e-6
        for part in (slice(0, 4), slice(0, None)):  # most are ruled out by a few words
            ok = np.bitwise_count(parity[a, part] ^ parity[b, part]).sum(1) <= most
            a, b, most = a[ok], b[ok], most[ok]
        found.append((a, b))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def deduplicate(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    number = "_row"
    while number in docs.columns:
        number += "_"
    rows = scratch.keep(docs.withColumn(number, F.monotonically_increasing_id()), "rows", "zstd")
    kept = classes(rows.select(F.col(number).alias("row"), "doc_id", "text"), least, written=True).filter("kept").select(F.col("row").alias(number))
    return rows.join(kept, number, "left_semi").drop(number)
