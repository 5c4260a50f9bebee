"""Removal of repeated substrings by sorting suffixes in range buckets.

A suffix of which the first WINDOW bytes also start in a document with a smaller id is
repeated, and those bytes are removed.  Sorting every suffix would multiply the
text by its suffixes' length, so only suffixes that can be repeated are sorted:

1. In each document, anchors are chosen by content: a position is one if its
   GRAM bytes have the least hash of some window of WINDOW bytes.  Equal windows
   have equal anchors at equal places, so windows whose anchor's bytes occur in
   one document only are unique and need no sorting.  Which hashes occur in two
   documents is found by sorting 32-bit hashes in hash buckets.
2. For the other anchors the windows they stand for go, as one segment of text,
   to a range bucket: splitters sampled from the anchors' leading bytes cut
   their order into ranges.  A run of equal leading bytes that is longer than a
   bucket is dealt over several.
3. A bucket sorts the suffixes of its segments by a multikey quicksort, eight
   bytes to a step, only ties going on to the next step, and marks each suffix
   that has an equal one in a smaller document.  Runs dealt over several buckets
   are compared across the boundaries: each bucket hands on its distinct suffixes
   with their least document, and these are merged.

Whole documents that are equal are not sorted again and again: of equal texts
the one with the smallest id stands for all; in the others everything is repeated.
Equal segments of one chunk are likewise sent once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import scratch

#: Bytes of the strings that are compared, and of an anchor.
WINDOW, GRAM = 50, 24
#: Start positions of anchors in a window.
REACH = WINDOW - GRAM + 1
#: Bytes of text of a chunk, and of a piece that is in memory as numbers.
CHUNK, PIECE = 8 << 20, 1 << 20
#: Bytes sent to a bucket, about.
BUCKET = 4 << 20
#: Chunks from which splitters are sampled, at least, and the part of their anchors that is.
SAMPLED, EVERY = 8, 16
#: Of many chunks, one of so many is sampled; so many times EVERY chunks and more are sampled the more thinly the more there are.
ONE_OF, THIN = 64, 4096
#: Sampled keys for each range at least, so that a splitter comes twice only where its key is frequent.
KEYS = 10
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over every ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        x = best(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def words(raw: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from each position on, as one number; ``raw`` must have seven bytes more."""
    return np.ndarray(len(raw) - 7, kind, raw.tobytes(), 0, (1,))


class Piece:
    """Some documents, or a part of one, with their anchors."""

    def __init__(self, texts: list[bytes], owners: list[int], bases: list[int]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text = b"".join(texts) + b"\0" * 8
        ends = np.cumsum(sizes)
        self.starts, self.owners, self.bases = ends - sizes, np.array(owners), np.array(bases)
        raw = np.frombuffer(self.text, np.uint8)
        eight = words(raw, "<u8")
        n = int(ends[-1]) - GRAM + 1
        h = np.zeros(n, np.uint64)
        for at in range(0, GRAM, 8):
            h = (h ^ eight[at : at + n]) * _M1
            h ^= h >> np.uint64(29)
        h *= _M2
        h ^= h >> np.uint64(32)
        h |= np.uint64(1)
        low = sliding(h, REACH, np.minimum)
        # a window that starts in the last bytes of a text reaches into the next: it is none
        for back in range(1, WINDOW):
            at = ends - back
            low[at[(at >= self.starts) & (at < len(low))]] = 0
        edge = np.zeros(REACH - 1, np.uint64)
        self.hash, self.low = h, low
        self.anchors = np.flatnonzero(sliding(np.concatenate([edge, low, edge]), REACH, np.maximum) == h)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def segments(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor: itself, the first and the last of the windows of which it is the first least."""
        at = at[at >= 0]
        same = np.full(len(at), -1)
        order = np.lexsort((at, self.hash[at]))
        near = (self.hash[at[order[1:]]] == self.hash[at[order[:-1]]]) & (at[order[1:]] - at[order[:-1]] < REACH)
        same[order[1:][near]] = at[order[:-1][near]]
        places = at[:, None] - np.arange(REACH - 1, -1, -1)
        held = (places > same[:, None]) & (places >= 0) & (places < len(self.low))
        held &= self.low[np.clip(places, 0, len(self.low) - 1)] == self.hash[at][:, None]
        some = held.any(1)
        first, last = held.argmax(1), REACH - 1 - held[:, ::-1].argmax(1)
        at, first, last = at[some], first[some], last[some]
        return at, at - (REACH - 1) + first, at - (REACH - 1) + last


def pieces(texts: list[bytes], skip: set[int]) -> Iterator[Piece]:
    """Pieces of bounded size; a text longer than one is cut so that each window lies in one piece."""
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for i, text in enumerate(texts):
        if i in skip or len(text) < WINDOW:
            continue
        for base in range(0, len(text) - WINDOW + 1, PIECE):
            part = text[base : base + PIECE + WINDOW - 1]
            for xs, x in zip(held, (part, i, base), strict=True):
                xs.append(x)
            size += len(part)
            if size >= PIECE:
                yield Piece(*held)
                held, size = ([], [], []), 0
    if size:
        yield Piece(*held)


def read(group: pa.Table, notes: pa.Table) -> tuple[np.ndarray, list[bytes], set[int], list[tuple[int, bytes]], list[int]]:
    """Ids and texts in a fixed order, places of the texts that an earlier one stands for, the other notes as (number, data), and the order."""
    ids, texts = group.column("doc_id").to_pylist(), group.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    doc, texts = np.array([ids[i] for i in order], np.int64), [texts[i] for i in order]
    sha = group.column("sha").to_pylist()
    copies, rest = set(), []
    for number, data, copy in zip(*(notes.column(c).to_pylist() for c in ("number", "data", "copy")), strict=True):
        if copy:
            copies.add((number, data))
        else:
            rest.append((number, data))
    skip = {k for k, i in enumerate(order) if (ids[i], sha[i]) in copies}
    return doc, texts, skip, rest, order


def same_runs(*keys: np.ndarray) -> np.ndarray:
    """First places of runs of equal neighbours."""
    differs = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for key in keys:
        differs |= key[1:] != key[:-1]
    return np.flatnonzero(np.r_[True, differs]) if len(keys[0]) else np.zeros(0, np.int64)


def multikey(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes ``at`` of ``raw`` by their first WINDOW bytes.

    Returns their order and the number of each one's group of equals.  A step
    sorts by eight bytes, in what was equal so far; groups of one are done.
    """
    eight = words(raw, ">u8")
    order = np.argsort(eight[at].astype(np.uint64), kind="stable")
    group = np.zeros(len(at), np.int64)
    key = eight[at[order]].astype(np.uint64)
    group[np.r_[False, key[1:] != key[:-1]]] = 1
    group = np.cumsum(group)
    for depth in [*range(8, WINDOW - 8, 8), WINDOW - 8]:
        size = np.bincount(group)
        live = np.flatnonzero(size[group] > 1)
        if not len(live):
            break
        key = eight[at[order[live]] + depth].astype(np.uint64)
        inner = np.lexsort((key, group[live]))
        order[live], key = order[live][inner], key[inner]
        cut = np.zeros(len(group), np.int64)
        cut[1:] = group[1:] != group[:-1]
        split = np.r_[False, (key[1:] != key[:-1])]
        cut[live[split]] = 1
        group = np.cumsum(cut)
    return order, group


def combine(segments: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows to go on with (those of the least document among equal segments), and which are repeated as a whole."""
    codes: dict[bytes, int] = {}
    code = np.fromiter((codes.setdefault(s, len(codes)) for s in segments), np.int64, len(segments))
    least = np.full(len(codes), np.iinfo(np.int64).max)
    np.minimum.at(least, code, doc)
    stay = doc == least[code]
    return stay, ~stay


def intervals(rows: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """Marked bytes as (place of the document, first byte, length) triples of 32-bit numbers, by a chunk."""
    return np.stack([x[rows] for x in spans], axis=1).astype("<u4").tobytes()


NOTES = "chunk int, number long, data binary, copy boolean"


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Find and remove bytes that repeat in a later document.

    Texts are UTF-8 bytes (null: none).  A byte is removed if a string of
    ``window`` bytes (50) that covers it also starts in a document with a smaller
    doc_id, judged on the texts as they are given.  Returns doc_id, n_bytes,
    spans (array of start and end, maximal runs, in order) and kept (the
    other bytes), one row for each row of ``docs``.  Rows with the same doc_id
    are not smaller than each other.  A null doc_id is neither smaller nor
    larger than any: nothing is removed there, nor because of it.  An empty table
    gives no rows.  Other columns of ``docs`` are not read.
    """
    if window != WINDOW:
        raise ValueError(f"window must be {WINDOW}")
    return _find(docs, [])


def _find(docs: DataFrame, carry: list[str]) -> DataFrame:
    """remove_repeats(), and with the columns ``carry`` in a struct named rest."""
    spark = docs.sparkSession
    carried = [F.struct(*carry).alias("rest")] if carry else []
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *carried)
    carried = ["rest"] if carry else []
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // CHUNK))
    # enough buckets that one holds about 128 MB, as far as Spark allows
    parts = min(100_000, max(scratch.partitions(spark), total >> 27))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk")
    # bucketed by chunk: the texts are shuffled once, each later pass brings only its notes to them
    name = f"lodestone_texts_{uuid.uuid4().hex}"
    given = rows.filter("doc_id is not null").select(chunk, "doc_id", "text", F.unhex(F.sha2("text", 256)).alias("sha"), *carried).repartition(parts, "chunk")
    given.write.bucketBy(parts, "chunk").option("path", f"{scratch.folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    first = scratch.keep(texts.groupBy("sha").agg(F.min("doc_id").alias("first_id")), "first")
    copies = texts.select("chunk", "doc_id", "sha").join(first, "sha").filter("doc_id > first_id").select("chunk", F.col("doc_id").alias("number"), F.col("sha").alias("data"), F.lit(True).alias("copy"))
    copies = scratch.keep(copies.distinct(), "copies")

    bare = texts.drop("rest")

    def with_notes(more: DataFrame | None, function, schema: str | T.StructType, some: DataFrame = bare) -> DataFrame:
        notes = copies if more is None else copies.unionByName(more)
        return some.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(function, schema)

    hash_bits = max(2 * parts, total // 14 * 4 // BUCKET).bit_length()

    def hashes(group: pa.Table, notes: pa.Table) -> pa.Table:
        doc, texts, skip, _, _ = read(group, notes)
        found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for piece in pieces(texts, skip):
            found.append(piece.hash[piece.anchors])
            owner.append(doc[piece.owners[piece.owner(piece.anchors)]])
        h, d = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        starts = same_runs(h)
        many = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts) if len(h) else np.zeros(0, bool)
        value = (h[starts] & np.uint64(0xFFFFFFFE)).astype(np.uint32) | many
        bucket = (h[starts] >> np.uint64(64 - hash_bits)).astype(np.int32)
        cuts = same_runs(bucket)
        edges = [*cuts.tolist(), len(bucket)]
        k = group.column("chunk")[0].as_py() if len(group) else 0
        data = [value[a:b].astype("<u4").tobytes() for a, b in zip(edges, edges[1:], strict=False)] if len(cuts) else []
        return pa.table({"chunk": pa.array([k] * len(cuts), pa.int32()), "number": pa.array(bucket[cuts].astype(np.int64)), "data": pa.array(data, pa.binary())})

    def repeated(group: pa.Table) -> pa.Table:
        """Of one hash bucket: for each chunk its hashes that occur in several documents."""
        own, bucket = group.column("chunk").to_pylist(), group.column("number")[0].as_py()
        parts = [np.frombuffer(x, "<u4") for x in group.column("data").to_pylist()]
        value, source = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(value | 1, kind="stable")
        value, source = value[order], source[order]
        starts = same_runs(value | 1)
        size = np.diff(np.r_[starts, len(value)])
        several = (size > 1) | (np.bitwise_or.reduceat(value, starts) & 1 > 0)
        keep = np.repeat(several, size)
        value, source = value[keep] >> 1, source[keep]
        order = np.argsort(source, kind="stable")
        value, source = value[order], source[order]
        edges = [*same_runs(source).tolist(), len(source)]
        data = [value[a:b].astype("<u4").tobytes() for a, b in zip(edges, edges[1:], strict=False)] if len(source) else []
        chunk = [own[source[a]] for a in edges[:-1]] if len(source) else []
        n = len(data)
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "number": pa.array([bucket] * n, pa.int64()), "data": pa.array(data, pa.binary()), "copy": pa.array([False] * n, pa.bool_())})

    blobs = with_notes(None, hashes, "chunk int, number long, data binary")
    masks = scratch.keep(blobs.groupBy("number").applyInArrow(repeated, NOTES), "masks")

    def suffixes(group: pa.Table, notes: pa.Table) -> tuple:
        """All segments of a chunk that may be repeated: bytes, anchor's place in it, document's place, id, first byte, windows."""
        doc, texts, skip, rest, _ = read(group, notes)
        wanted = [np.frombuffer(data, "<u4").astype(np.uint64) | np.uint64(number) << np.uint64(32) for number, data in rest]
        known = np.sort(np.concatenate(wanted)) if wanted else np.zeros(0, np.uint64)
        segments: list[bytes] = []
        out: list[tuple] = []
        for piece in pieces(texts, skip) if len(known) else ():
            h = piece.hash[piece.anchors]
            key = (h >> np.uint64(64 - hash_bits)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFE)) >> np.uint64(1)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            anchor, low, high = piece.segments(piece.anchors[known[at] == key])
            text = piece.text
            segments.extend(text[a:b] for a, b in zip(low.tolist(), (high + WINDOW).tolist(), strict=True))
            of = piece.owner(low)
            place = piece.owners[of]
            out.append((anchor - low, place, doc[place], low - piece.starts[of] + piece.bases[of], high - low + 1))
        lead, place, owner, pos, n = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5
        return segments, lead, place, owner, pos, n

    def sample(group: pa.Table, notes: pa.Table) -> pa.Table:
        segments, lead, _, owner, _, _ = suffixes(group, notes)
        stay, _ = combine(segments, owner)
        rows = np.flatnonzero(stay)[::every].tolist()
        return pa.table({"key": pa.array([segments[i][lead[i] : lead[i] + GRAM] for i in rows], pa.binary())})

    sampled, every = min(chunks, max(SAMPLED, chunks // ONE_OF)), max(EVERY, chunks // THIN)
    some = with_notes(masks, sample, "key binary", bare.filter(F.col("chunk") < sampled)).toArrow()  # THIN / ONE_OF chunks' keys at most, or those of SAMPLED by EVERY
    keys = np.sort(np.array(some.column("key").to_pylist(), f"S{GRAM}"))
    ranges = max(2 * parts, len(keys) * every * chunks // sampled * 80 // BUCKET)
    ranges = max(2, min(ranges, len(keys) // KEYS))
    splitters = keys[np.linspace(0, len(keys) - 1, ranges + 1).astype(int)[1:-1]] if len(keys) else keys
    value, times = np.unique(splitters, return_counts=True)
    dealt = set(value[times > 1].tolist())  # leading bytes of runs that lie in several buckets

    def send(group: pa.Table, notes: pa.Table) -> pa.Table:
        segments, lead, place, owner, pos, n = suffixes(group, notes)
        k = group.column("chunk")[0].as_py() if len(group) else 0
        stay, whole = combine(segments, owner)
        rows = np.flatnonzero(stay)
        key = np.array([segments[i][a : a + GRAM] for i, a in zip(rows.tolist(), lead[rows].tolist(), strict=True)], f"S{GRAM}")
        left, right = np.searchsorted(splitters, key, side="left"), np.searchsorted(splitters, key, side="right")
        salt = (owner[rows] * 1_000_003 + pos[rows]) % np.maximum(right - left, 1)
        bucket = np.where(right - left > 1, left + 1 + salt, right)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        edges = [*same_runs(bucket).tolist(), len(rows)]
        out = []
        for a, b in zip(edges, edges[1:], strict=False) if len(rows) else ():
            own = rows[a:b]
            numbers = np.stack([lead[own], place[own], owner[own], pos[own], n[own]]).astype("<i8")
            out.append((k, int(bucket[a]), numbers.tobytes(), b"".join(segments[i] for i in own.tolist())))
        if whole.any():  # repeated in this chunk: nothing to sort, but to mark
            out.append((k, -1 - k % ranges, intervals(np.flatnonzero(whole), (place, pos, n + WINDOW - 1)), None))
        kinds = {"chunk": pa.int32(), "bucket": pa.int32(), "numbers": pa.binary(), "text": pa.binary()}
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.table({c: pa.array(x, t) for (c, t), x in zip(kinds.items(), columns, strict=True)})

    MARKS = "chunk int, number long, data binary, copy boolean, window binary, least long, first int, place int"

    def sort(group: pa.Table) -> pa.Table:
        """Of one bucket: marks for each chunk, and the suffixes that other buckets must be asked about."""
        chunk, numbers, text = (group.column(c).to_pylist() for c in ("chunk", "numbers", "text"))
        marks: list[tuple] = [(c, 0, x, False, None, None, None, None) for c, x, t in zip(chunk, numbers, text, strict=True) if t is None]
        sent = [(c, np.frombuffer(x, "<i8").reshape(5, -1), t) for c, x, t in zip(chunk, numbers, text, strict=True) if t is not None]
        if sent:
            lead, place, owner, pos, n = np.concatenate([x for _, x, _ in sent], axis=1)
            of = np.repeat(np.array([c for c, _, _ in sent]), [x.shape[1] for _, x, _ in sent])
            body = b"".join(t for _, _, t in sent)
            ends = np.cumsum(n + WINDOW - 1)
            starts = ends - (n + WINDOW - 1)
            segments = [body[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            stay, whole = combine(segments, owner)
            rows = np.flatnonzero(stay)
            row = np.repeat(rows, n[rows])
            step = np.arange(len(row)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
            raw = np.frombuffer(body + b"\0" * 8, np.uint8)
            order, equal = multikey(raw, starts[row] + step)
            row, step = row[order], step[order]
            first = same_runs(equal)
            least = np.minimum.reduceat(owner[row], first)[equal] if len(row) else owner[row]
            late = owner[row] > least
            # runs of neighbouring suffixes of a segment make one interval
            r, s = row[late], step[late]
            order = np.lexsort((s, r))
            r, s = r[order], s[order]
            cut = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)]) if len(r) else np.zeros(0, int)
            length = np.diff(np.r_[cut, len(r)])
            w = np.flatnonzero(whole)
            spans = np.r_[place[r[cut]], place[w]], np.r_[pos[r[cut]] + s[cut], pos[w]], np.r_[length, n[w]] + WINDOW - 1
            by = np.r_[of[r[cut]], of[w]]
            order = np.argsort(by, kind="stable")
            edges = [*same_runs(by[order]).tolist(), len(order)]
            for a, b in zip(edges, edges[1:], strict=False) if len(order) else ():
                marks.append((int(by[order[a]]), 0, intervals(order[a:b], spans), False, None, None, None, None))
            if dealt:
                is_open = np.array([segments[i][lead[i] : lead[i] + GRAM].rstrip(b"\0") in dealt for i in rows.tolist()], bool)
                open_row = np.zeros(len(n), bool)
                open_row[rows[is_open]] = True
                for i in np.flatnonzero(open_row[row] & ~late).tolist():
                    a = int(starts[row[i]] + step[i])
                    marks.append((int(of[row[i]]), 0, None, None, body[a : a + WINDOW], int(owner[row[i]]), int(pos[row[i]] + step[i]), int(place[row[i]])))
        kinds = {"chunk": pa.int32(), "number": pa.int64(), "data": pa.binary(), "copy": pa.bool_(), "window": pa.binary(), "least": pa.int64(), "first": pa.int32(), "place": pa.int32()}
        columns = zip(*marks, strict=True) if marks else [()] * 8
        return pa.table({c: pa.array(x, t) for (c, t), x in zip(kinds.items(), columns, strict=True)})

    sent = with_notes(masks, send, "chunk int, bucket int, numbers binary, text binary")
    marks = scratch.keep(sent.groupBy("bucket").applyInArrow(sort, MARKS), "marks")
    across = marks.filter("window is not null")
    least = scratch.keep(across.groupBy("window").agg(F.min("least").alias("first_id")), "least")
    late = across.join(least, "window").filter("least > first_id").select("chunk", F.col("place").cast("long").alias("number"), F.col("first").cast("string").cast("binary").alias("data"), F.lit(False).alias("copy"))
    notes = marks.filter("window is null").select("chunk", F.lit(-1).cast("long").alias("number"), "data", "copy").unionByName(late)

    def cut(group: pa.Table, notes: pa.Table) -> pa.Table:
        doc, texts, skip, rest, order = read(group, notes)
        spans = [np.frombuffer(data, "<u4").astype(np.int64).reshape(-1, 3) for number, data in rest if number < 0]
        spans.append(np.array([(number, int(data), WINDOW) for number, data in rest if number >= 0], np.int64).reshape(-1, 3))
        place, start, length = np.concatenate(spans).T
        by = np.lexsort((start, place))
        place, start, end = place[by], start[by], (start + length)[by]
        at = np.searchsorted(place, np.arange(len(texts) + 1)).tolist()
        found, kept = [], []
        for i, text in enumerate(texts):
            if i in skip and len(text) >= WINDOW:
                own = [(0, len(text))]
            else:
                own = []
                for a, b in zip(start[at[i] : at[i + 1]].tolist(), end[at[i] : at[i + 1]].tolist(), strict=True):
                    if own and a <= own[-1][1]:
                        own[-1] = (own[-1][0], max(own[-1][1], b))
                    else:
                        own.append((a, b))
            found.append([{"start": a, "end": b} for a, b in own])
            kept.append(b"".join(text[a:b] for a, b in zip([0, *(b for _, b in own)], [*(a for a, _ in own), len(text)], strict=True)))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "n_bytes": pa.array(map(len, texts), pa.int64()), "spans": pa.array(found, span), "kept": pa.array(kept, pa.binary())} | ({"rest": group.column("rest").take(pa.array(order))} if carried else {}))

    result = T.StructType.fromDDL("doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    if carried:
        result = result.add(rows.schema["rest"])
    out = with_notes(notes, cut, result, texts)
    nameless = rows.filter("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.from_json(F.lit("[]"), "array<struct<start: long, end: long>>").alias("spans"), F.col("text").alias("kept"), *carried)
    return out.unionByName(nameless)



def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, text without what remove_repeats() finds, and n_chars (if there is such a column) to match.

    A character of which only some bytes are removed goes as a whole.  A null text becomes an empty one.
    """
    left = F.col("kept").cast("string")
    text = F.when(F.is_valid_utf8(left), left).otherwise(F.replace(F.make_valid_utf8(left), F.lit("\ufffd"), F.lit("")))
    out = _find(docs, [c for c in docs.columns if c != "text"]).withColumn("_text", text)
    own = {"text": F.col("_text"), "n_chars": F.char_length("_text")}
    return out.select(*[own.get(c, F.col("rest")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
