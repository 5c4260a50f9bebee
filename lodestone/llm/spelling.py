"""Spelling variants: words one edit apart, found by a positional q-gram index with a count filter.

Words that differ by one inserted, deleted or replaced character share at least
max(lengths) - 2 * Q + 1 grams of Q characters, in the same order, each at its
own place or one further.  Of Q + 1 grams of a word at least one is among those
shared, so with the grams put in one order for all words (rarest first, then by
place) two such words share one of their first Q + 1.  The edit is right of that
gram or left of it: then all up to the gram, or all from it on, is the same.
Words meet in a task by that part and by length, which a popular gram alone
can't make large.  There, the words' other grams are indexed by gram and place;
the postings that a word's grams ask for, under limits of length and place, are
merged through a heap; words met as often as the bound says, less the grams that
all of them have in common, are compared.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import scratch

#: Characters of a gram; words must have at least 2 * Q.
Q = 3
#: Grams that are broadcast at most, some 30 MB; with more of them the join is left to Spark.
GRAMS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged_words(docs: DataFrame, every: int = 199, least: int = 2 * Q) -> DataFrame:
    """One row, word, for each run of Latin letters in the texts, with A-Z lower-cased, that has ``least`` characters.

    Of a document's run whose CRC-32 of "<doc_id>:<run>" ``every`` divides, the character at that number modulo the
    run's length is left out first.  A null id is an empty one, a null text has no runs.
    """
    # a run that is too short can't become long enough; greedy matches from the left are the maximal runs
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), 0)
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    crc, size = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.length("run")
    at = (crc % size).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr(F.col("run"), at + 2, size))
    return found.select(F.when(crc % every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether one character inserted into ``a`` or replaced in it makes ``b``."""
    if len(a) == len(b):
        low, high = 0, len(a)  # the same but for what is between
        while high - low > 1:
            half = (low + high) // 2
            if a[low:half] == b[low:half]:
                low = half
            elif a[half:high] == b[half:high]:
                high = half
            else:
                return False
        return a != b
    if len(b) - len(a) != 1:
        return False
    low, high = 0, len(a)  # the first letters that are the same: at least low, at most high
    while low < high:
        half = (low + high + 1) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half - 1
    return a[low:] == b[low + 1 :]


def meet(words: list[str], indexed: list[bool], same: list[int]) -> Iterator[tuple[int, int]]:
    """Places (probe, other) of the pairs one edit apart among words of one key.

    The indexed words have one length, the others one less; a pair of indexed words comes once.  All have their first
    ``same`` grams in common, or their last ones where that is negative.  Where hashes of keys are equal by chance there
    can be more lengths and parts, and each is indexed by itself.
    """
    for size, many in {(len(w), n) for w, own, n in zip(words, indexed, same, strict=True) if own}:
        some = [k for k, w in enumerate(words) if same[k] == many and (len(w) == size - 1 or len(w) == size and indexed[k])]
        yield from _meet(size, many, some, words)


def _meet(size: int, same: int, places: list[int], words: list[str]) -> Iterator[tuple[int, int]]:
    bound = size - 2 * Q + 1 - abs(same)  # grams that two words must share besides those that all share
    full = [k for k in places if len(words[k]) == size]
    if bound <= 0:  # at most 2 * Q - 3 characters are free: every indexed word is met often enough
        for k in places:
            for other in full:
                if (other > k or len(words[k]) < size) and one_edit(words[k], words[other]):
                    yield k, other
        return
    first, last = max(same, 0), Q - 1 + max(-same, 0)
    postings: list[dict[str, list[int]]] = [{} for _ in range(size)]
    for k in full:
        w = words[k]
        for p in range(first, size - last):
            postings[p].setdefault(w[p : p + Q], []).append(k)
    for k in places:
        w, lists = words[k], []
        for p in range(first, len(w) - last):
            g = w[p : p + Q]
            if (x := postings[p].get(g)) and x[-1] != k:
                lists.append(x)
            if len(w) < size and (x := postings[p + 1].get(g)):
                lists.append(x)
        if len(lists) < bound:
            continue
        for other, times in groupby(heapq.merge(*lists)):
            if (other > k or len(w) < size) and other != k and (bound == 1 or len(list(times)) >= bound) and one_edit(w, words[other]):
                yield k, other


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in whole runs of equal keys; batches come sorted by key, and a run may go on in the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        if held and held[-1].column("key")[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _groups(batches):
        keys, own, same = (table.column(c).to_numpy() for c in ("key", "own", "same"))
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        many, owners = np.diff(edges), np.add.reduceat(own.astype(np.int64), edges[:-1])
        left, right = [], []
        for a, n in zip(edges[:-1][(many > 1) & (owners > 0)].tolist(), many[(many > 1) & (owners > 0)].tolist(), strict=True):
            for x, y in meet(table.column("word").slice(a, n).to_pylist(), own[a : a + n].tolist(), same[a : a + n].tolist()):
                left.append(a + x)
                right.append(a + y)
        for k in range(0, len(left), 1 << 16):
            a, b = (table.select(["word", "n"]).take(x[k : k + (1 << 16)]).combine_chunks() for x in (left, right))
            both = pa.table([*a.columns, *b.columns], ["word", "n", "near", "near_n"])
            yield from both.to_batches()


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n of every two words one edit apart, each pair once in either order of its words.

    ``words`` has a number (row), distinct words of at least 2 * Q characters, and n; it is a written table.  A gram's
    row doesn't carry its word, whose length has no bound.
    """
    size = F.length("word")
    spelt = words.select("row", F.split("word", "").alias("letters"))
    gram = lambda p: F.struct(p.alias("p"), F.concat(*(F.get("letters", p + k) for k in range(Q))).alias("gram"))
    grams = spelt.select("row", F.explode(F.transform(F.sequence(F.lit(0), F.size("letters") - Q), gram)).alias("at")).select("row", "at.p", "at.gram")
    common = scratch.keep(grams.groupBy("gram").agg(F.count("*").alias("many")), "grams")
    ranked = grams.join(F.broadcast(common) if common.count() <= GRAMS else common, "gram")
    first = F.slice(F.array_sort(F.collect_list(F.struct("many", "gram", "p"))), 1, Q + 1)
    rare = ranked.groupBy("row").agg(first.alias("first")).join(words, "row").select("word", "n", F.explode("first.p").alias("p"))

    def key(side: str, length: Column) -> Column:
        part = F.substr("word", F.lit(1), F.col("p") + Q) if side == "left" else F.substr("word", F.col("p") + 1, size)
        return F.xxhash64(F.lit(side), length, part)  # equal hashes of unlike parts only add words to compare

    same = {"left": F.col("p") + 1, "right": F.col("p") + Q - 1 - size}  # grams of that part, from the beginning or the end
    places = [F.struct(key(side, size + more).alias("key"), F.lit(not more).alias("own"), same[side].cast("int").alias("same")) for side in ("left", "right") for more in (0, 1)]
    sent = rare.select("word", "n", F.explode(F.array(*places)).alias("to")).select("to.key", "to.own", "to.same", "word", "n")
    met = scratch.arrow(sent.repartition("key").sortWithinPartitions("key"), _near, "word string, n long, near string, near_n long")
    turned = F.col("word") > F.col("near")  # the same pair can meet under several keys
    ordered = met.select(*(F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("word", "near"), ("n", "near_n"), ("near", "word"), ("near_n", "n"))))
    return ordered.distinct()


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word and root: where following ``forms`` (word, form) from a word ends.

    Each step multiplies n by at least the ratio, so a chain has ``most`` steps at most; each round doubles the steps taken.
    """
    at = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(max(most, 1)))):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        last, at = at, scratch.keep(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        scratch.drop(last)
    return at


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Each word with the more common spelling that it is likely meant to be.

    ``words`` has word (distinct, 2 * Q characters at least) and n (how often it occurs, 1 at least).  Two words are
    near if they differ by exactly one inserted, deleted or replaced character.  A word's form is its near word of
    largest n, of equals the first in code-point order, if that n is at least ``ratio`` times its own; else null.
    Returns one row a word: word, form, root (where the forms from it on end, the word itself where it has none), n,
    n_near (near words) and form_n.  No words give no rows.
    """
    words = scratch.keep(words.select(F.monotonically_increasing_id().alias("row"), "word", F.col("n").cast("long").alias("n")), "words")
    pairs = scratch.keep(near_pairs(words), "near")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("turned"), "near")).alias("best")
    met = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    good = -F.col("best.turned") >= ratio * F.col("n")
    met = scratch.keep(met.select("word", "n_near", F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.turned")).alias("form_n")), "forms")
    largest = words.agg(F.max("n")).first()[0] or 1
    ends = roots(met.filter("form is not null"), math.floor(math.log(largest, ratio)) + 1)
    out = words.drop("row").join(met, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, every: int = 199, least: int = 2 * Q, times: int = 5, ratio: int = 5) -> DataFrame:
    """variants() of the damaged_words() of ``docs`` that occur at least ``times`` times.

    Every row's whole text counts, repeated rows and ids each time; a null or empty text has no words, a run of any
    length is one word; other columns are not read.
    """
    if least < 2 * Q:
        raise ValueError(f"words of fewer than {2 * Q} characters can be near without a common gram")
    words = damaged_words(docs, every, least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)
    return variants(words, ratio)
