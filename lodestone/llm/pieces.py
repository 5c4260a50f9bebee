"""SentencePiece encoding and decoding by a table of distinct chunks.

The model files are those of the ``sentencepiece`` library of the kind BPE with
byte fallback and identity normalisation.  A space becomes the marker ▁, one
more marker goes in front of the text, and no piece holds a marker behind
another character.  So no piece crosses the place before a run of markers, and
a text's ids are those of its chunks, each of which begins with such a run.

A slice of texts is cut into chunks, each distinct chunk is segmented once (what
a worker knows already, not at all), and the ids come back to their places by
the chunk's number.  The new chunks lie in one flat array of symbols; a round
merges in each of them the leftmost pair of best score, as the library's queue
does, and chunks without a pair that merges leave the array.  Chunks that are
long, as texts without spaces are, take the same steps through a heap, which
costs n log n.  Both give what the library gives.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import scratch
from lodestone.llm.arrow import slices

MARK = "▁"
#: Fixed values of the model file's format: the kinds of pieces.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NONE = np.int64(1 << 40)
#: Chunks of more characters go through the heap.
LONG = 48
#: Distinct chunks that a Python worker remembers.
REMEMBERED = 800_000


class Pieces:
    """One model file, ready to encode and decode."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: not a BPE model with byte fallback, identity normalisation and a marker in front")
        names, kinds = [p.piece for p in spec.pieces], [p.type for p in spec.pieces]
        if not {*kinds} <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: pieces of a kind that is not supported")
        own = {p: i for i, (p, k) in enumerate(zip(names, kinds, strict=True)) if k == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in own):
            raise ValueError(f"{path}: a piece crosses a marker, so chunks can't be segmented apart")
        if any(c not in own for p in own for c in p):
            raise ValueError(f"{path}: a piece has a character that is no piece")
        self.bos, self.eos = names.index(train.bos_piece), names.index(train.eos_piece)
        byte = {names[i]: i for i, k in enumerate(kinds) if k == BYTE}
        self.bytes = [byte[f"<0x{b:02X}>"] for b in range(256)]
        # which pieces two neighbours make, and how good that is: equal scores are equal ranks
        scores = [spec.pieces[i].score for i in own.values()]
        rank_of = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        made = {(own[p[:k]] << 20 | own[p[k:]]): i for p, i in own.items() for k in range(1, len(p)) if p[:k] in own and p[k:] in own}
        self.pairs = {key: (rank_of[spec.pieces[i].score], i) for key, i in made.items()}
        self.keys = np.array(sorted(made), np.int64)
        self.rank = np.array([self.pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([made[k] for k in self.keys.tolist()], np.int64)
        # a character that is a piece has its id as symbol, any other its code point behind the ids; those never merge
        self.size = len(names)
        self.symbol = np.arange(self.size, self.size + 0x110000, dtype=np.int64)
        for p, i in own.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.table = [b"" if k == CONTROL else spec.trainer_spec.unk_surface.encode() if k == UNKNOWN else bytes([self.bytes.index(i)]) if k == BYTE else n.replace(MARK, " ").encode() for i, (n, k) in enumerate(zip(names, kinds, strict=True))]
        self.marked = [k == NORMAL and n.startswith(MARK) for n, k in zip(names, kinds, strict=True)]
        self.silent = [k == CONTROL for k in kinds]
        self.known: dict[str, bytes] = {}

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE where it doesn't merge) and what it makes."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = (self.keys[at] == key) & (left < self.size) & (right < self.size)
        return np.where(good, self.rank[at], NONE), self.merged[at]

    def _pack(self, symbols: np.ndarray, owner: np.ndarray, chunks: int) -> list[bytes]:
        """Ids of each chunk as little-endian 32-bit integers; symbols that are no piece become the ids of their bytes."""
        strange = np.flatnonzero(symbols >= self.size)
        if len(strange):
            coded = [np.array([self.bytes[b] for b in chr(s - self.size).encode()], np.int64) for s in symbols[strange].tolist()]
            width = np.ones(len(symbols), np.int64)
            width[strange] = [len(c) for c in coded]
            out = np.repeat(symbols, width)
            starts = (np.cumsum(width) - width)[strange]
            for a, c in zip(starts.tolist(), coded, strict=True):
                out[a : a + len(c)] = c
            symbols, owner = out, np.repeat(owner, width)
        raw = symbols.astype("<u4").tobytes()
        edges = np.r_[0, 4 * np.cumsum(np.bincount(owner, minlength=chunks))].tolist()
        return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def merge(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, all chunks in rounds. No chunk may be empty."""
        if not chunks:
            return []
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        sym = self.symbol[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")]
        owner = np.repeat(np.arange(len(chunks)), sizes)
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            got, made[:-1] = self._look_up(sym[:-1], sym[1:])
            rank[:-1] = np.where(owner[1:] == owner[:-1], got, NONE)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            many = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            live = np.repeat(least < NONE, many)
            if not live.all():
                done.append((owner[~live], sym[~live]))
                keep = least < NONE
                sym, owner, rank, made, many, least = sym[live], owner[live], rank[live], made[live], many[keep], least[keep]
                if not len(sym):
                    break
            best = np.flatnonzero(rank == np.repeat(least, many))
            at = best[np.r_[True, owner[best[1:]] != owner[best[:-1]]]]  # the leftmost in each chunk
            sym[at] = made[at]
            kept = np.ones(len(sym), bool)
            kept[at + 1] = False
            sym, owner, rank, made = sym[kept], owner[kept], rank[kept], made[kept]
            at -= np.arange(len(at))  # one place has gone before each merge of an earlier chunk
            again = np.r_[at, at[at > 0] - 1]
            rank[again] = NONE
            again = again[again < len(sym) - 1]
            again = again[owner[again] == owner[again + 1]]
            rank[again], made[again] = self._look_up(sym[again], sym[again + 1])
        owner, sym = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(owner, kind="stable")
        return self._pack(sym[order], owner[order], len(chunks))

    def heap(self, chunk: str) -> bytes:
        """Ids of one long chunk: the best pair, leftmost of equals, comes from a heap; neighbours are linked."""
        sym = self.symbol[np.frombuffer(chunk.encode("utf-32-le"), "<u4")].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = lambda a, b: self.pairs.get(sym[a] << 20 | sym[b]) if sym[a] < self.size and sym[b] < self.size else None
        queue = [(p[0], k, p[1], sym[k], sym[k + 1]) for k in range(n - 1) if (p := pair(k, k + 1))]
        heapq.heapify(queue)
        while queue:
            _, a, made, left, right = heapq.heappop(queue)
            b = after[a]
            if sym[a] != left or b >= n or sym[b] != right:
                continue  # one of them has been merged meanwhile
            sym[a], sym[b] = made, -1
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            for x, y in ((before[a], a), (a, after[a])):
                if x >= 0 and y < n and (p := pair(x, y)):
                    heapq.heappush(queue, (p[0], x, p[1], sym[x], sym[y]))
        left = np.array([s for s in sym if s >= 0], np.int64)
        return self._pack(left, np.zeros(len(left), np.int64), 1)[0]

    def learn(self, chunks: set[str]) -> None:
        """Segment the distinct chunks that aren't known yet."""
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = dict(list(self.known.items())[len(self.known) // 2 :]) if len(new) < REMEMBERED // 2 else {}
            new = [c for c in chunks if c not in self.known]
        short = [c for c in new if len(c) <= LONG]
        self.known.update(zip(short, self.merge(short), strict=True))
        self.known.update((c, self.heap(c)) for c in new if len(c) > LONG)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        cut = [chunks_of(t) for t in texts]
        self.learn({c for cs in cut for c in cs})
        begin, end, get = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little"), self.known.__getitem__
        return [b"".join((begin, *map(get, cs), end)) for cs in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: markers become spaces, the one in front goes, control pieces are silent, bytes that are no UTF-8 become U+FFFD each."""
        own = ids.tolist()
        first = next((k for k, i in enumerate(own) if not self.silent[i]), len(own))
        raw = b"".join(map(self.table.__getitem__, own[first:]))
        if first < len(own) and self.marked[own[first]]:
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def chunks_of(text: str) -> list[str]:
    """The marked chunks of a text: each is a run of markers and what follows up to the next one."""
    if not text:
        return []
    words = (" " + text.replace(MARK, " ")).split(" ")[1:]
    if "" not in words:
        return [MARK + w for w in words]
    out, marks = [], 0
    for w in words:
        marks += 1
        if w:
            out.append(MARK * marks + w)
            marks = 0
    return [*out, MARK * marks] if marks else out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The model at ``path``, read once in each Python worker."""
    return Pieces(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text and decode its ids again.

    Returns doc_id, n_tokens (long, begin and end counted), packed (binary: the
    ids as little-endian unsigned 32-bit integers) and decoded (string), one row
    for each row of ``docs``, repeated and null ids included.  A null text
    counts as empty: begin and end, empty string.  Other columns of ``docs`` are
    not read.  A text of any length is handled whole, one without spaces as one
    chunk; memory follows the longest text.  Nothing is shuffled: a chunk that
    many tasks meet is segmented once in each worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pieces(path)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                coded = tool.encode([t or "" for t in part.column("text").to_pylist()])
                text = [tool.decode(np.frombuffer(c, "<u4")) for c in coded]
                counts = pa.array([len(c) // 4 for c in coded], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), counts, pa.array(coded, pa.binary()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "packed", "decoded"])

    return scratch.arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, packed binary, decoded string")


def ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs``, with begin and end; nulls and empty texts as in encode_decode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pieces(path)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                coded = tool.encode([t or "" for t in part.column("text").to_pylist()])
                flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
                edges = np.r_[0, np.cumsum([len(c) // 4 for c in coded])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], ["doc_id", "ids"])

    return scratch.arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids array<int>")
