"""Crowded buckets of near-duplicates: rows that are shipped, and no alike pair lost."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import neardup

from .test_llm import brute_classes, sentence


def unlike(rnd, n):
    """Texts with one passage in common and the rest of their own, a twentieth of them with a relative that is alike."""
    passage = sentence(rnd, 14)
    out = []
    for i in range(n):
        words = (passage + " " + " ".join(f"{rnd.randrange(10**9)}" for _ in range(30))).split()
        out.append((i, " ".join(words)))
        if i % 20 == 0:
            out.append((10**6 + i, " ".join([*words[:-1], "other"])))
    return out


def shipped(spark, n):
    """Rows that meet in blocks of one bucket of n texts, each under its own label, and the pairs found in them."""
    texts = spark.createDataFrame(unlike(random.Random(n), n), "row long, text string").cache()
    own = texts.select(F.lit(1).cast("long").alias("sketch"), "row", F.col("row").alias("label"))
    prepared = texts.select("row", F.col("row").alias("doc_id"), "text").mapInArrow(lambda b: neardup._prepare(b, 81), "row long, doc_id long, text string, sig binary, size long, sketch array<long>, parity binary, label array<long>")
    prepared = prepared.select("row", "size", "parity").cache()
    dealt = neardup._spread(own, texts, 0.8)
    pairs = {(r.row, r.centre) for r in neardup._across(dealt, prepared, 0.8).collect()}
    return neardup._blocks(dealt, prepared).count(), pairs


def test_rows_grow_with_the_bucket(spark):
    """Not with its square: 2,000 rows are below the bound and meet in blocks, larger buckets by their rarest shingles."""
    counts = {}
    for n in (2000, 4000, 8000):
        counts[n], pairs = shipped(spark, n)
        assert {(10**6 + i, i) for i in range(0, n, 20)} <= pairs
    assert counts[4000] < 10 * 4200 and counts[8000] < 2.3 * counts[4000]


@pytest.mark.parametrize("crowd", [0, 2])
def test_no_class_is_lost(spark, crowd, monkeypatch):
    """All buckets crowded, and most: chains of copies, long and short texts, blanks."""
    rnd = random.Random(crowd)
    texts = []
    for _ in range(12):
        words = sentence(rnd, rnd.choice([6, 12, 40, 130, 400])).split()
        for _ in range(rnd.randrange(1, 8)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(max(1, len(words) // rnd.choice([12, 25, 60]))):
                words[rnd.randrange(len(words))] = rnd.choice(["x", "changed", "ka"])
    rows = list(enumerate([*texts, None, "", " ", texts[0], "a b"]))
    monkeypatch.setattr(neardup, "CROWD", crowd)
    got = {}
    for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(x) for x in got.values()} == brute_classes(rows)
