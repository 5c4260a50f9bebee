"""Many literal patterns in many texts, in one pass: Aho-Corasick automata of a table of patterns.

An automaton holds the first letters of each pattern (a seed); where a seed ends,
the patterns that begin with it are compared.  Patterns are dealt into parts of a
bounded size, and each part's automaton is made once in each Python worker.  A
text is read once for each part, from left to right, whatever the number of its
patterns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of a seed, and patterns and characters of a part at most: an automaton takes some 100 MB then.
SEED, PATTERNS, CHARACTERS = 16, 100_000, 16_000_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, most: int = 4 << 20) -> DataFrame:
    """rows.mapInArrow() in batches of about ``most`` bytes; Spark reads that bound when the job starts, so it is set in the session where that names none."""
    if rows.sparkSession.conf.get(BATCH_BYTES, None) is None:
        rows.sparkSession.conf.set(BATCH_BYTES, most)
    return rows.mapInArrow(function, schema)


class Automaton:
    """Finds all places of all patterns in a text."""

    def __init__(self, patterns: list[str]):
        seeds: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            if p:
                seeds.setdefault(p[:SEED], []).append(i)
        self.patterns, self.empty = patterns, [i for i, p in enumerate(patterns) if not p]
        self.machine = ahocorasick.Automaton()
        for seed, own in seeds.items():
            self.machine.add_word(seed, (len(seed), own))
        self.machine.make_automaton()
        self.any = bool(seeds)

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        """Number of the pattern, and where it begins (from 0); the empty pattern is found once, at the beginning."""
        yield from ((i, 0) for i in self.empty)
        for end, (size, own) in self.machine.iter(text) if self.any else ():
            start = end - size + 1
            for i in own:
                if size < SEED or text.startswith(self.patterns[i], start):
                    yield i, start


_made: dict[str, Automaton] = {}


def _automaton(name: str, patterns: list[str]) -> Automaton:
    if name not in _made:
        _made.clear()  # one in a worker
        _made[name] = Automaton(patterns)
    return _made[name]


def _parts(patterns: DataFrame, pattern_key: str, pattern: str) -> Iterator[list[tuple]]:
    """The patterns in parts of bounded size; they pass through the driver one part after another."""
    part, size = [], 0
    for r in patterns.select(pattern_key, pattern).filter(F.col(pattern).isNotNull()).toLocalIterator():
        if part and (len(part) >= PATTERNS or size + len(r[1]) > CHARACTERS):
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += len(r[1])
    if part:
        yield part


def find(docs: DataFrame, patterns: DataFrame, key: str, pattern_key: str, text: str = "text", pattern: str = "pattern", once: bool = False) -> DataFrame:
    """Where each pattern stands in each text: pattern_key, key, start (characters, from 0) and end (behind the last one).

    ``docs`` has key and text, ``patterns`` has pattern_key and pattern.  Upper and lower case are told apart; places
    may overlap, and all are given; an empty pattern is found once in each text, at its beginning.  With ``once``, of a
    text and a pattern the first place only.  Null texts and null patterns are in no row; repeated rows of either table
    give rows of their own.
    """
    spark = docs.sparkSession
    kinds = {**dict(docs.dtypes), **dict(patterns.dtypes)}
    schema = f"{pattern_key} {kinds[pattern_key]}, {key} {kinds[key]}, start int, end int"
    types = [to_arrow_type(patterns.schema[pattern_key].dataType), to_arrow_type(docs.schema[key].dataType), pa.int32(), pa.int32()]
    sought = uuid.uuid4().hex
    texts = docs.select(key, F.col(text).alias("_text")).filter(F.col(text).isNotNull())
    out = None
    for number, part in enumerate(_parts(patterns, pattern_key, pattern)):
        shared = spark.sparkContext.broadcast(part)  # bounded by PATTERNS and CHARACTERS

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=f"{sought}/{number}") -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            names, words = zip(*shared.value, strict=True)
            tool = _automaton(name, list(words))
            for batch in batches:
                found: tuple[list, ...] = ([], [], [], [])
                for row, t in zip(batch.column(key).to_pylist(), batch.column("_text").to_pylist(), strict=True):
                    seen = set()
                    for i, start in tool.places(t):
                        if once:
                            if i in seen:
                                continue
                            seen.add(i)
                        for column, value in zip(found, (names[i], row, start, start + len(words[i])), strict=True):
                            column.append(value)
                    if len(found[0]) > 1 << 16:
                        yield _batch(found, types, pattern_key, key)
                        found = ([], [], [], [])
                if found[0]:
                    yield _batch(found, types, pattern_key, key)

        rows = in_batches(texts, run, schema)
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], schema) if out is None else out


def _batch(found: tuple[list, ...], types: list[pa.DataType], pattern_key: str, key: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, types, strict=True)], [pattern_key, key, "start", "end"])
