"""BPE encoding and decoding by batched numpy merge rounds.

The vocabulary files are those of the ``tokenizers`` library of the kind with
word ends (``</w>``): NFC, white space runs, lower case, words by a pattern,
bytes as characters, merges by rank.  The words of a batch lie in one flat
array of symbols.  A round finds, for every word at once, the lowest-ranked
adjacent pair (binary search over the sorted pair keys) and merges it wherever
it stands in that word; words without a pair that merges leave the array.
Merges learned later only ever use symbols made earlier, so the rounds give
what merging one pair at a time gives.
"""

from __future__ import annotations

import json
import string
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import scratch
from lodestone.llm.arrow import slices

NONE = np.int64(1 << 40)
#: Characters that the vocabulary's pattern counts as white space (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: str.split() also splits on these, which are not white space to the vocabulary's pattern.
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Encoded words that a Python worker remembers.
REMEMBERED = 800_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: its own where printable in Latin-1, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


class Codec:
    """One vocabulary file, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
            raise ValueError(f"{path}: not a BPE vocabulary with word ends")
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + "</w>"] for c in chars], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.names = {i: s for s, i in {**vocab, **special}.items()}
        self.table = [self.names.get(i, "") for i in range(max(self.names) + 1)]
        self.known: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and each word's count of ids. No word may be empty."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, owner = self.inner[raw], np.repeat(np.arange(len(words)), sizes)
        sym[ends - 1] = self.final[raw[ends - 1]]
        rank = np.full(len(sym), NONE)
        if len(sym) > 1:
            rank[:-1] = np.where(owner[1:] == owner[:-1], self._ranks(sym[:-1], sym[1:]), NONE)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, starts)
            here = np.repeat(least, np.diff(np.r_[starts, len(sym)]))
            live = here < NONE
            if not live.all():
                done.append((owner[~live], sym[~live]))
                sym, owner, rank, here = sym[live], owner[live], rank[live], here[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == here)
            # x x x: pairs at consecutive places overlap; from each run take every second one
            first = np.r_[True, np.diff(at) != 1]
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
            sym[at] = self.merged[rank[at]]
            kept = np.ones(len(sym), bool)
            kept[at + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            sym, owner, rank, changed = sym[kept], owner[kept], rank[kept], changed[kept]
            changed[:-1] |= changed[1:]
            again = np.flatnonzero(changed)
            inside = again[again < len(sym) - 1]
            rank[again] = NONE
            rank[inside] = np.where(owner[inside] == owner[inside + 1], self._ranks(sym[inside], sym[inside + 1]), NONE)
        owner, sym = (np.concatenate([d[k] for d in done]) for k in (0, 1)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(owner, kind="stable")
        return sym[order], np.bincount(owner, minlength=len(words))

    def words(self, run: str) -> list[str]:
        """The words of a run of text without white space."""
        if run.isascii():
            low = run.lower()
            core = low.rstrip(string.punctuation)
            if core.isalpha():  # letters, then perhaps one word of punctuation
                return [core] if len(core) == len(low) else [core, low[len(core) :]]
            return self.pattern.findall(low)
        run = unicodedata.normalize("NFC", run).replace("Σ", "σ")  # lower case goes by character: no final sigma
        return self.pattern.findall(run.lower())

    def learn(self, runs: Iterable[list[str]]) -> None:
        """Encode the runs not yet known, all at once."""
        wanted = set(chain.from_iterable(runs))
        new = [r for r in wanted if r not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > REMEMBERED:
            late = list(self.known.items())[len(self.known) // 2 :] if len(new) < REMEMBERED // 2 else []
            self.known = dict(late)
            new = [r for r in wanted if r not in self.known]
        split = list(map(self.words, new))
        words = list({w for ws in split for w in ws})
        ids, sizes = self.merge([w.encode() for w in words])
        buffer = ids.astype("<u4").tobytes()
        edges = np.r_[0, 4 * np.cumsum(sizes)].tolist()
        coded = {w: buffer[a:b] for w, a, b in zip(words, edges, edges[1:], strict=False)}.__getitem__
        self.known.update((r, coded(ws[0]) if len(ws) == 1 else b"".join(map(coded, ws))) for r, ws in zip(new, split, strict=True))

    def runs(self, text: str) -> list[str]:
        if SEPARATORS.search(text):
            return [r for r in regex.split(f"[{SPACE}]+", text) if r]
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [[(p, p in self.special) for p in self.cut.split(t)] if self.cut and "<" in t else [(t, False)] for t in texts]
        split = [[[p] if s else self.runs(p) for p, s in ps] for ps in parts]
        self.learn(rs for ps, ss in zip(parts, split, strict=True) for (_, s), rs in zip(ps, ss, strict=True) if not s)
        get, out = self.known.__getitem__, []
        for ps, ss in zip(parts, split, strict=True):
            out.append(b"".join(self.special[p].to_bytes(4, "little") if s else b"".join(map(get, rs)) for (p, s), rs in zip(ps, ss, strict=True)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary's strings joined by a space, which is what the file's absent decoder means."""
        return " ".join(map(self.table.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The vocabulary at ``path``, read once in each Python worker."""
    return Codec(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text and decode its ids again.

    Returns doc_id, ids (array of int), decoded (string), one row for each row
    of ``docs``, repeated and null ids included.  A null text counts as empty:
    no ids, empty string.  Other columns of ``docs`` are not read.  A text of
    any length is handled whole; memory follows the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                coded = tool.encode([t or "" for t in part.column("text").to_pylist()])
                each = [np.frombuffer(c, "<u4") for c in coded]
                flat = np.concatenate(each).astype(np.int32)
                offsets = np.r_[0, np.cumsum([len(e) for e in each])].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array([tool.decode(e) for e in each], pa.string())], ["doc_id", "ids", "decoded"])

    return scratch.arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids array<int>, decoded string")


def lengths(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens (null text: 0) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                coded = tool.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(c) // 4 for c in coded], pa.int64())], ["doc_id", "n_tokens"])

    return scratch.arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long")
