"""Language-model scores by the likelihood of the subword lattice.

A word is made of pieces of an existing vocabulary, the last of which is a
word-final one.  Every way to cut the word into pieces counts: a forward
recursion in log space adds up all of them.  The pieces' weights start equal;
rounds of expectation-maximisation over the words of the training documents,
each as often as it occurs, re-estimate them.  A text is its words and one end:
every token is the end with the share that ends have in training, or else a word with its marginal
probability, so the probabilities of all texts add up to one.

Words are counted in hash buckets.  A chunk of documents sends each of its distinct words
once, with its count, so no word is in a bucket more often than there are chunks; a
bucket answers each chunk with counts and scores in the order it asked.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import scratch
from lodestone.llm.arrow import slices
from lodestone.llm.bpe import byte_characters

#: Bytes of text of a chunk; bytes of words in a bucket, about.
CHUNK, BUCKET = 8 << 20, 2 << 20
#: Rounds of expectation-maximisation, and what is added to each expected count.
ROUNDS, ADDED = 4, 0.05
_BASE = np.uint64(0x9E3779B97F4A7C15)


def fold(code: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A substring's code with one byte more."""
    code = (code ^ (byte + np.uint64(1))) * _BASE
    return code ^ code >> np.uint64(31)


@dataclass
class Pieces:
    """The vocabulary: codes of the pieces in order, and natural-log weights. Word-final pieces are numbered from ``inner`` on."""

    inner: int
    longest: int
    codes: tuple[np.ndarray, np.ndarray]
    weight: np.ndarray
    #: for each side: the first code with these leading bits, and the most codes that share them
    index: tuple[tuple[np.ndarray, int], ...]

    @classmethod
    def read(cls, path: str) -> Pieces:
        """Pieces of a vocabulary file with word ends, all of the same weight."""
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        of = {c: b for b, c in enumerate(byte_characters())}
        sides: tuple[list, list] = ([], [])
        for name in vocab:
            final = name.endswith("</w>") and name != "</w>"
            sides[final].append(bytes(of[c] for c in name.removesuffix("</w>" if final else "")))
        codes, index, longest = [], [], 0
        for side in sides:
            code = []
            for piece in side:
                c = np.zeros(1, np.uint64)
                for b in piece:
                    c = fold(c, np.array([b], np.uint64))
                code.append(c[0])
                longest = max(longest, len(piece))
            codes.append(np.sort(np.array(code, np.uint64)))
            first = np.searchsorted(codes[-1] >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)
            index.append((first, int(np.diff(first).max())))
        n = sum(map(len, codes))
        return cls(len(codes[0]), longest, tuple(codes), np.full(n, -math.log(n)), tuple(index))

    def find(self, code: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of the codes that are pieces, and the pieces' numbers."""
        codes, (first, most) = self.codes[final], self.index[final]
        top = (code >> np.uint64(44)).astype(np.int64)
        start, end = first[top], first[top + 1]
        on = np.flatnonzero(end > start)
        start, own = start[on], code[on]
        piece = np.full(len(on), -1, np.int64)
        for k in range(most):
            at = np.minimum(start + k, len(codes) - 1)
            piece = np.where(codes[at] == own, at, piece)
        hit = piece >= 0
        return on[hit], piece[hit] + self.inner * final

    def lattice(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, dict, np.ndarray]]:
        """For the words of each length: their places, the pieces on each edge, and the forward scores."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if not len(own):
                continue
            n = int(sizes[own[0]])
            step = max(1, (4 << 20) // (n * min(n, self.longest)))
            for at in range(0, len(own), step):
                rows = own[at : at + step]
                raw = np.frombuffer(b"".join(words[i] for i in rows.tolist()), np.uint8).reshape(len(rows), n).T.astype(np.uint64)
                edges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
                forward = np.full((n + 1, len(rows)), -np.inf)
                forward[0] = 0
                for i in range(n):
                    code = np.zeros(len(rows), np.uint64)
                    for j in range(i + 1, min(n, i + self.longest) + 1):
                        code = fold(code, raw[j - 1])
                        on, piece = self.find(code, j == n)
                        if len(on):
                            edges[i, j] = on, piece
                            forward[j, on] = np.logaddexp(forward[j, on], forward[i, on] + self.weight[piece])
                yield rows, edges, forward

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural-log probability of each word, over all its segmentations."""
        out = np.zeros(len(words))
        for rows, _, forward in self.lattice(words):
            out[rows] = forward[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece in the words, each of which occurs ``counts`` times."""
        total = np.zeros(len(self.weight))
        for rows, edges, forward in self.lattice(words):
            times = counts[rows]
            n = len(forward) - 1
            backward = np.full(forward.shape, -np.inf)
            backward[n] = 0
            for (i, j), (on, piece) in sorted(edges.items(), key=lambda e: -e[0][0]):
                backward[i, on] = np.logaddexp(backward[i, on], backward[j, on] + self.weight[piece])
            for (i, j), (on, piece) in edges.items():
                share = times[on] * np.exp(forward[i, on] + self.weight[piece] + backward[j, on] - forward[n, on])
                total += np.bincount(piece, share, len(total))
        return total


def words_of(text: str) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def split_words(data: bytes) -> list[bytes]:
    return data.split(b" ") if data else []


CHUNKS = "chunk long, bucket int, doc_id array<long>, held_out array<boolean>, sizes binary, numbers binary, words binary, counts binary"


def score(docs: DataFrame, path: str) -> DataFrame:
    """Score every text by a model learned from the rows whose ``held_out`` is false.

    ``docs`` has doc_id, text and held_out (null: false).  Returns doc_id,
    held_out, n_tokens (words and one end), n_known (tokens that training has), train_tokens,
    base_score (add-one unigram, log10) and score (the lattice's marginal probability, log10), one
    row for each row of ``docs``, repeated and null ids included.  A null text
    counts as empty: one token, its end.  Without a training row every count is 0 and all
    pieces weigh the same.  An empty table gives no rows.  Words of any length
    are scored whole.
    """
    spark = docs.sparkSession
    parts = scratch.partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"), F.monotonically_increasing_id().alias("row"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * parts, total // 5 // BUCKET + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                held.append(tuple(part.column(c).to_pylist() for c in ("doc_id", "text", "held_out", "row")))
                size += part.nbytes
                if size >= CHUNK:
                    yield chunk(held)
                    held, size = [], 0
        if held:
            yield chunk(held)

    def chunk(held: list[tuple]) -> pa.RecordBatch:
        """A row for the documents, and a row for each bucket with the words that are sent to it."""
        ids, texts, out, row = ([x for part in held for x in part[k]] for k in range(4))
        known: dict[bytes, int] = {}
        sizes, numbers = [], []
        for text in texts:
            own = words_of(text)
            sizes.append(len(own))
            numbers.extend([known.setdefault(w, len(known)) for w in own])
        number = np.array(numbers, np.int64)
        train = np.repeat(~np.array(out, bool), sizes)
        counts = np.bincount(number[train], minlength=len(known)) if len(known) else np.zeros(0, np.int64)
        words = list(known)
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        edges = [*(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(words)] if len(words) else []
        made = [(row[0], -1, ids, out, np.array(sizes, "<i4").tobytes(), place[number].astype("<i4").tobytes(), None, None)]
        for a, b in zip([0, *edges], edges, strict=False):
            own = order[a:b].tolist()
            made.append((row[0], int(bucket[own[0]]), None, None, None, None, b" ".join(words[i] for i in own), counts[own].astype("<i4").tobytes()))
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), kinds, strict=True)], ["chunk", "bucket", "doc_id", "held_out", "sizes", "numbers", "words", "counts"])

    chunks = scratch.keep(scratch.arrow(rows, count, CHUNKS), "chunks")
    sent = chunks.filter("bucket >= 0").select("chunk", "bucket", "words", "counts")

    def merge(group: pa.Table) -> pa.Table:
        """One row with the distinct words of a bucket and their counts, and for each chunk where its words are among them."""
        bucket = group.column("bucket")[0].as_py()
        known: dict[bytes, int] = {}
        at = [np.array([known.setdefault(w, len(known)) for w in split_words(x)], np.int64) for x in group.column("words").to_pylist()]
        counts = np.zeros(len(known), np.int64)
        for places, x in zip(at, group.column("counts").to_pylist(), strict=True):
            counts[places] += np.frombuffer(x, "<i4")
        n = len(at)
        return pa.table({
            "bucket": pa.array([bucket] * (n + 1), pa.int32()),
            "chunk": pa.array([None, *group.column("chunk").to_pylist()], pa.int64()),
            "words": pa.array([b" ".join(known), *[None] * n], pa.binary()),
            "data": pa.array([counts.astype("<i8").tobytes(), *(p.astype("<i4").tobytes() for p in at)], pa.binary()),
            "tokens": pa.array([int(counts.sum()), *[None] * n], pa.int64()),
            "types": pa.array([int((counts > 0).sum()), *[None] * n], pa.int64()),
        })

    merged = scratch.keep(sent.groupBy("bucket").applyInArrow(merge, "bucket int, chunk long, words binary, data binary, tokens long, types long"), "vocabulary")
    vocabulary = merged.filter("chunk is null")
    train_words, types = (x or 0 for x in vocabulary.agg(F.sum("tokens"), F.sum("types")).first())
    ends = chunks.filter("bucket < 0").agg(F.sum(F.size(F.filter("held_out", lambda x: ~x)))).first()[0] or 0
    distinct, n_all = types + (ends > 0), train_words + ends
    pieces = Pieces.read(path)
    for _ in range(ROUNDS if types else 0):

        def expect(batches: Iterator[pa.RecordBatch], model: Pieces = pieces) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(model.weight))
            for batch in batches:
                for words, data in zip(batch.column("words").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    own, counts = split_words(words), np.frombuffer(data, "<i8")
                    known = np.flatnonzero(counts)
                    total += model.expected([own[i] for i in known.tolist()], counts[known])
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "n"])

        expected = np.full(len(pieces.weight), ADDED)
        for r in vocabulary.select("words", "data").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # at most a row for each piece
            expected[r.piece] += r.n
        pieces = replace(pieces, weight=np.log(expected / expected.sum()))
    stop, go = math.log10((ends + 1) / (n_all + 2)), math.log10((train_words + 1) / (n_all + 2))

    def answer(group: pa.Table) -> pa.Table:
        """For each chunk: count and score of each of its words in this bucket."""
        model = pieces
        chunk, words, data = (group.column(c).to_pylist() for c in ("chunk", "words", "data"))
        own = chunk.index(None)
        counts = np.frombuffer(data[own], "<i8")
        both = np.empty(len(counts), [("count", "<i8"), ("score", "<f8")])
        both["count"], both["score"] = counts, go + model.score(split_words(words[own])) / math.log(10)
        rest = [k for k in range(len(chunk)) if k != own]
        return pa.table({
            "chunk": pa.array([chunk[k] for k in rest], pa.int64()),
            "bucket": pa.array(group.column("bucket").to_pylist()[:1] * len(rest), pa.int32()),
            "data": pa.array([both[np.frombuffer(data[k], "<i4")].tobytes() for k in rest], pa.binary()),
        })

    answers = merged.select("bucket", "chunk", "words", "data").groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, data binary")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = sorted(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist(), strict=True))
        known = np.frombuffer(b"".join(d for _, d in parts), [("count", "<i8"), ("score", "<f8")])
        base = np.log10((known["count"] + 1) / (n_all + distinct + 1))
        # a null chunk number can't be: each chunk has one row of documents
        number = np.frombuffer(left.column("numbers")[0].as_py(), "<i4")
        sizes = np.frombuffer(left.column("sizes")[0].as_py(), "<i4").astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        n = len(sizes)
        end = math.log10((ends + 1) / (n_all + distinct + 1))
        return pa.table({
            "doc_id": pa.array(left.column("doc_id")[0].as_py(), pa.int64()),
            "held_out": pa.array(left.column("held_out")[0].as_py(), pa.bool_()),
            "n_tokens": pa.array(sizes + 1),
            "n_known": pa.array(np.bincount(owner[known["count"][number] > 0], minlength=n) + int(ends > 0)),
            "train_tokens": pa.array([n_all] * n, pa.int64()),
            "base_score": pa.array(np.bincount(owner, base[number], n) + end),
            "score": pa.array(np.bincount(owner, known["score"][number], n) + stop),
        })

    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    documents = chunks.filter("bucket < 0").select("chunk", "doc_id", "held_out", "sizes", "numbers")
    return documents.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add, result)
