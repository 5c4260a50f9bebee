"""Phrase collocations: suffix automata of shards, counts reduced over all of them.

A suffix automaton's states are the classes of substrings that end at the same
places (endpos), and its suffix links lead from a class to that of the longest
suffix with more ends.  Turned round, the links are the trie of the reversed
substrings.  Up to a bounded depth that trie is made level by level in arrays
instead of word by word: the ends of depth d, sorted by the state of their last
d - 1 words and the word before these, fall into the states of depth d; how many
fall into one is its endpos count, and the state they came from is its link.  A
shard is some megabytes of texts, all its pieces in one automaton; the states
are its phrases up to the depth, each with its count, and are added up over all
shards by phrase.

What is rare anyway isn't sent as text.  A first pass counts words and pairs by
hashes; those that occur often enough set bits in a sieve of fixed size.  A second
one counts by hashes the longer phrases all of whose words and pairs the sieve
lets through.  The third one sends the phrases whose every part passes.  Hashes
that fall together let too much through, never too little: counts are those of
the phrases' texts.  With more frequent phrases than the sieve has room for it
lets all through, and more is sent, no result changes.

Every phrase of a frequent one is frequent, so all that scores and subsumption
need is among the frequent phrases.  A phrase that lies in a longer one lies in
one longer by a word that occurs at least as often: subsumption looks along the
suffix links (first word left out) and at phrases without the last word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import scratch

#: Bytes of text of one shard, or one longer text.
SHARD = 2 << 20
#: Bits of the sieve (8 MB), a power of two; the driver holds it, and every worker.
SIEVE = 1 << 26
#: Bits of a hash (fewer take less room on their way), and where in them the two places in the sieve begin.
KEY, PLACES = 44, (0, 18)
#: White space inside a piece, and what ends one.
ENDS = b".,;:!?\n\x0b\x0c\r"
_MAP = bytes(10 if b in ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Shard:
    """Tokens of some texts: code of the word, number of the piece and code of the language, by place."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        data = np.frombuffer(b"\n".join([*texts, b""]).translate(_MAP), np.uint8)
        ends, inside = data == 10, (data != 10) & (data != 32)
        edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
        starts, sizes = edge[::2], edge[1::2] - edge[::2]
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        self.words: pa.Array = words.dictionary
        self.code = words.indices.to_numpy().astype(np.int64)
        self.piece = np.cumsum(ends)[starts]
        self.langs = sorted({*langs})
        number = {x: k for k, x in enumerate(self.langs)}
        of_text = np.array([number[x] for x in langs], np.int64)
        last = np.cumsum([len(t) + 1 for t in texts])
        self.lang = of_text[np.searchsorted(last, starts, "right")] if len(texts) else np.zeros(0, np.int64)

    def keys(self, depth: int) -> list[np.ndarray]:
        """For 1, 2, ... ``depth`` words: hash of those that end at each place, with the language; 0 where a piece doesn't have so many."""
        word = np.array([xxhash.xxh64_intdigest(w) for w in self.words.to_pylist()], np.uint64)[self.code]
        lang = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.langs], np.uint64)
        whole, out = mixed(word + lang[self.lang]), []
        inside = np.ones(len(whole), bool)
        for d in range(depth):
            if d:
                whole = np.r_[np.zeros(1, np.uint64), mixed(whole[:-1] * np.uint64(5) + word[1:])] if len(whole) else whole
                inside[:d] = False
                inside[d:] &= self.piece[d:] == self.piece[: len(inside) - d]
            out.append(np.where(inside, whole >> np.uint64(64 - KEY) | np.uint64(1), np.uint64(0)))
        return out

    def states(self, allowed: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Depth, an end, endpos count and suffix link (a state of the depth before) of the states of each depth.

        ``allowed`` says, for phrases of 1, 2, ... words, of each place whether the one that ends there may be frequent.
        """
        size = max(len(self.words), 1)
        ends, root = np.arange(len(self.code)), self.lang
        for d, may in enumerate(allowed, 1):
            ends = ends[may[ends]]
            _, first, state_of, count = np.unique(root[ends] * size + self.code[ends - d + 1], return_index=True, return_inverse=True, return_counts=True)
            yield d, ends[first], count, root[ends[first]]
            root = np.zeros(len(self.code), np.int64)
            root[ends] = state_of

    def phrases(self, ends: np.ndarray, words: int) -> pa.Array:
        """The phrases of so many words at ``ends``, joined by spaces."""
        parts = [self.words.take(pa.array(self.code[ends - k])) for k in range(words - 1, -1, -1)]
        return (pc.binary_join_element_wise(*parts, b" ") if words > 1 else parts[0]).cast(pa.string())


def mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on each bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Shard]:
    """Texts of several batches, ``most`` bytes at a time."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for t, x in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if texts and size + len(t) > most:
                yield Shard(texts, langs)
                texts, langs, size = [], [], 0
            texts.append(t)
            langs.append(x)
            size += len(t) + 1
    if texts:
        yield Shard(texts, langs)


Batches = Iterator[pa.RecordBatch]


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which phrases the sieve lets through; key 0 is none."""
    out = keys != 0
    for s in PLACES:
        at = (keys >> np.uint64(s)) & np.uint64(64 * len(bits) - 1)
        out &= ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out


def allowed(bits: np.ndarray, keys: list[np.ndarray]) -> list[np.ndarray]:
    """Of phrases of 1, 2, ... words that end at each place, which pass with all their parts."""
    out = [passes(bits, keys[0])]
    for own in keys[1:]:  # its first words end one place before, its last words here
        before = np.r_[np.zeros(1, bool), out[-1][:-1]] if len(own) else out[-1]
        out.append(passes(bits, own) & out[-1] & before)
    return out


def _hashes(get_bits: Callable[[], np.ndarray] | None, depth: int, most: int) -> Callable[[Batches], Batches]:
    """key and n of each shard: of words and pairs, or where there are bits already, of longer phrases of what passes them."""

    def run(batches: Batches) -> Batches:
        for shard in shards(batches, most):
            keys = shard.keys(depth)
            if get_bits:
                may, longer = allowed(get_bits(), keys[:2])[1], []
                for own in keys[2:]:  # all pairs in it pass
                    may = may & np.r_[np.zeros(1, bool), may[:-1]] if len(own) else may
                    longer.append(own[may & (own != 0)])
                keys = longer
            found, counts = np.unique(np.concatenate([k[k != 0] for k in keys]), return_counts=True)
            for k in range(0, len(found), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 18)].astype(np.int64)) for x in (found, counts)], ["key", "n"])

    return run


def sieve(hashes: DataFrame, least: int) -> np.ndarray:
    """A bit field of fixed size with two bits set for each key that occurs ``least`` times."""
    often = hashes.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    bit = F.explode(F.array(*(F.shiftrightunsigned("key", s).bitwiseAND(SIEVE - 1) for s in PLACES))).alias("bit")
    slots = often.select(bit).groupBy(F.shiftright("bit", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS INT))")).alias("bits"))
    out = np.zeros(SIEVE // 64, np.uint64)
    found = slots.toArrow()  # SIEVE / 64 rows at most
    out[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _counted(get_bits: Callable[[], np.ndarray], depth: int, most: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        names = ["lang", "words", "phrase", "n"]
        for shard in shards(batches, most):
            langs = pa.array(shard.langs, pa.string())
            every = np.bincount(shard.lang, minlength=len(langs))
            yield pa.RecordBatch.from_arrays([langs, pa.array([0] * len(langs), pa.int32()), pa.array([""] * len(langs)), pa.array(every)], names)
            for d, ends, count, _ in shard.states(allowed(get_bits(), shard.keys(depth))):
                for k in range(0, len(ends), 1 << 16):
                    at = ends[k : k + (1 << 16)]
                    size = pa.array(np.full(len(at), d, np.int32))
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(shard.lang[at])), size, shard.phrases(at, d), pa.array(count[k : k + (1 << 16)])], names)

    return run


def frequent_phrases(docs: DataFrame, least: int, depth: int = 4) -> DataFrame:
    """lang, words (how many), phrase and n of all phrases of up to ``depth`` words that occur ``least`` times in their language.

    Rows with 0 words hold each language's number of word occurrences, however small.  A null text is empty, a null
    lang is "und"; every row counts, repeated ones too.  ``docs`` is read three times.  A text of any length is handled
    whole; memory follows the longest one.
    """
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    context = docs.sparkSession.sparkContext
    bits = sieve(scratch.arrow(texts, _hashes(None, min(depth, 2), SHARD), "key long, n long"), least)
    if depth > 2:
        pairs = context.broadcast(bits)
        bits = bits | sieve(scratch.arrow(texts, _hashes(lambda: pairs.value, depth, SHARD), "key long, n long"), least)
    shared = context.broadcast(bits)
    found = scratch.arrow(texts, _counted(lambda: shared.value, depth, SHARD), "lang string, words int, phrase string, n long")
    counts = found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return counts.filter((F.col("n") >= least) | (F.col("words") == 0))


def _first(frame: DataFrame, most: int, spark: SparkSession) -> DataFrame:
    """The first ``most`` rows of each lang with their rank: first of each of many parts, then of what these leave."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(scratch.partitions(spark)))
    some = frame.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most)
    return some.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = 30, depth: int = 4, most: int = 2000, share: int = 80) -> DataFrame:
    """The phrases of each language whose words belong together.

    Texts are lower-cased (A-Z only) and split into pieces at . , ; : ! ? and line ends, pieces into words at spaces and
    tabs.  Candidates are the phrases of 2 to ``depth`` words that occur a >= ``least`` times in their language, within
    pieces, overlaps included.  A cut after the first k words has the counts l and r of its two parts and scores
    floor(2000000 a / (l + r)); a candidate's lowest-scoring cut counts, of equals that with the smallest k.  A candidate
    whose words lie in a longer candidate that occurs at least ``share`` percent as often is dropped.  Returns each
    lang's first ``most`` (score and a descending, phrase ascending in byte order): lang, rank, phrase, a, l, r, n (the
    language's word occurrences) and score.  Arithmetic is exact.  Nulls and long texts as in frequent_phrases(); no
    rows give no rows.
    """
    spark = docs.sparkSession
    counts = scratch.keep(frequent_phrases(docs, least, depth), "phrases")
    known, totals = counts.filter("words > 0").select("lang", "phrase", "words", "n"), counts.filter("words = 0").select("lang", F.col("n").alias("total"))
    candidates = known.filter("words > 1").withColumnRenamed("n", "a")
    tail = lambda k: F.expr(f"substring_index(phrase, ' ', {k} - words)")  # noqa: E731  what follows the first k words
    # along the suffix link, and without the last word
    inner = F.explode(F.array(tail(1), F.expr("substring_index(phrase, ' ', words - 1)"))).alias("phrase")
    longer = candidates.filter("words > 2").select("lang", inner, "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    kept = candidates.join(longer, ["lang", "phrase"], "left").filter(F.isnull("longer") | (exact("longer") * 100 < exact("a") * share)).drop("longer")
    cut = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("first"), F.expr("substring_index(phrase, ' ', k)").alias("part")), F.struct(F.lit(False).alias("first"), F.expr("substring_index(phrase, ' ', k - words)").alias("part")))).alias("side")
    parts = known.select("lang", F.col("phrase").alias("part"), F.col("n").alias("part_n"))
    met = cut.select("lang", "phrase", "a", "k", sides).select("lang", "phrase", "a", "k", "side.first", "side.part").join(parts, ["lang", "part"])
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("part_n"))).alias("l"), F.max(F.when(~F.col("first"), F.col("part_n"))).alias("r"))
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)")
    lowest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    scored = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    out = _first(scored, most, spark).join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
