"""Language identification by multilingual mixture inference.

Each learned language has a distribution over hashed byte trigrams, counted over
all labelled training documents.  A document is a mixture of languages; its
proportions are found by expectation-maximisation over its trigram counts.  Which
languages belong to the mixture is decided by penalised likelihood: the sets of
the one, two, ... strongest languages are fitted in turn, and the one whose
likelihood less its penalty is highest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import scratch
from lodestone.llm.arrow import slices

#: Hash values of a trigram.
FEATURES = 4096
#: EM rounds.
ROUNDS = 12
#: Penalty for each further language: nats for each trigram, and times the log of their number.
PER_TRIGRAM, PER_LOG = 0.01, 3.0
#: Documents whose counts are held as one matrix, their bytes at most, and bytes of a longer text that are counted at once.
DOCS, BYTES = 256, 4 << 20

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Texts in lower case with a space on either side, with their places, about BYTES at a time.

    A longer text comes in parts, each with the last two bytes of the part before it, so that each of its trigrams is in one part.
    """
    places, held, size = [], [], 0
    for k, t in enumerate(pc.utf8_lower(pc.fill_null(texts, "")).to_pylist()):
        own = f" {t} ".encode()
        for at in range(0, max(1, len(own) - 2), BYTES):
            part = own[at : at + BYTES + 2]
            if held and size + len(part) > BYTES:
                yield np.array(places), held
                places, held, size = [], [], 0
            places.append(k)
            held.append(part)
            size += len(part)
    if held:
        yield np.array(places), held


def features(padded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in one array (other ASCII than lower-case letters counts as a space) and their number for each text."""
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    raw = _LETTER[np.frombuffer(b"".join(padded), np.uint8)].astype(np.uint32)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    hashed = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    # a trigram that starts in the last two bytes of a text belongs to no text
    ends = np.cumsum(sizes)
    inside = np.ones(len(raw), bool)
    inside[ends - 1] = False
    inside[np.maximum(ends - 2, 0)] = False
    return hashed[inside[: len(hashed)]], np.maximum(sizes - 2, 0)


def matrix(texts: pa.Array) -> np.ndarray:
    """Trigram counts: one row for each text."""
    total = np.zeros((len(texts), FEATURES), np.float32)
    for place, padded in pieces(texts):
        hashed, sizes = features(padded)
        row = np.repeat(np.arange(len(sizes)), sizes)
        total[place] += np.bincount(row * FEATURES + hashed, minlength=len(sizes) * FEATURES).reshape(len(sizes), FEATURES)  # a text is there once
    return total


@dataclass
class Model:
    """Learned languages, their trigram probabilities and their shares of the training documents."""

    languages: list[str]
    probability: np.ndarray
    prior: np.ndarray

    def infer(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of counts: the mixture's main language (index) and its proportion."""
        p = self.probability
        n = np.maximum(counts.sum(1), 1)
        single = counts @ np.log(p).T + np.log(self.prior)
        best, top = single.max(1), single.argmax(1)
        share = np.ones(len(counts))
        penalty = PER_TRIGRAM * n + PER_LOG * np.log(n + 1)
        mixed, like = self.fit(counts, np.full((len(counts), len(p)), 1 / len(p), np.float32))
        rank = np.argsort(-mixed, axis=1, kind="stable")
        chosen = best.copy()
        for m in range(2, len(p) + 1):
            # no set of m languages is likelier than all of them together
            rows = np.flatnonzero(like - (m - 1) * penalty > chosen)
            if not len(rows):
                break
            start = np.zeros((len(rows), len(p)), np.float32)
            np.put_along_axis(start, rank[rows, :m], 1 / m, axis=1)
            part, fitted = self.fit(counts[rows], start)
            value = fitted - (m - 1) * penalty[rows]
            won = value > chosen[rows]
            rows, part = rows[won], part[won]
            chosen[rows], top[rows], share[rows] = value[won], part.argmax(1), part.max(1)
        return top, np.clip(share, 0, 1)

    def fit(self, counts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """EM for the proportions from where ``share`` is not zero; returns them and the log-likelihood."""
        p = self.probability
        n = np.maximum(counts.sum(1, keepdims=True), 1)
        for _ in range(ROUNDS):
            share = share * ((counts / (share @ p)) @ p.T) / n
            share /= np.maximum(share.sum(1, keepdims=True), 1e-30)
        return share, np.einsum("ij,ij->i", counts, np.log(share @ p))


def train(docs: DataFrame) -> Model:
    """Count trigrams of every row of ``docs`` with a text and a lang, for each lang. The driver gets FEATURES numbers a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs):
                    seen = total.setdefault(lang, np.zeros(FEATURES + 1, np.int64))
                    seen[FEATURES] += int((langs == lang).sum())
                for place, padded in pieces(part.column("text")):
                    hashed, sizes = features(padded)
                    owner = np.repeat(place, sizes)
                    for lang in set(langs[place]):
                        total[lang][:FEATURES] += np.bincount(hashed[(langs == lang)[owner]], minlength=FEATURES)
        for lang, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], ["lang", "feature", "n"])

    rows = docs.filter("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    sums = scratch.arrow(rows, count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in sums})
    counts, seen = np.zeros((len(languages), FEATURES)), np.zeros(len(languages))
    for r in sums:
        if r.feature == FEATURES:
            seen[languages.index(r.lang)] = r.n
        else:
            counts[languages.index(r.lang), r.feature] = r.n
    smooth = counts + 0.5
    return Model(languages, (smooth / smooth.sum(1, keepdims=True)).astype(np.float32), seen / max(seen.sum(), 1))


def predict(model: Model, text: str | Column = "text") -> Column:
    """Struct of lang_pred and score for each text.

    lang_pred is the language with the largest proportion in the chosen mixture,
    score that proportion.  A null text, a text without a letter, and every text
    where no language was learned give ``und`` and 0.
    """

    @F.pandas_udf("lang_pred string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            names, scores = np.full(len(part), "und", object), np.zeros(len(part))
            rows = np.flatnonzero(part.notna().to_numpy())
            for at in range(0, len(rows) if model.languages else 0, DOCS):
                own = rows[at : at + DOCS]
                top, share = model.infer(matrix(pa.array(part.iloc[own], pa.large_string())))
                names[own], scores[own] = np.array(model.languages, object)[top], share
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    text = F.col(text) if isinstance(text, str) else text
    asked = F.when(text.rlike(r"\p{L}"), text)
    # declared so, lest a filter on the result runs it once more
    return run.asNondeterministic()(asked)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``; see predict(). Null and repeated ids keep their rows; an empty table gives none."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), predict(model, F.col("text").cast("string")).alias("p"))
    return out.select("doc_id", "p.lang_pred", "p.score")
