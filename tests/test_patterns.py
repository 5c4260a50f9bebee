"""Pattern automata and vector cells against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import patterns, search
from lodestone.operators.vector_index import VectorIndex


def plain(texts, words):
    out = []
    for i, p in words:
        for k, t in texts:
            if t is not None and p is not None:
                places = [0] if not p else [m.start() for m in re.finditer(f"(?={re.escape(p)})", t)]
                out += [(i, k, a, a + len(p)) for a in places]
    return sorted(out)


@pytest.mark.parametrize("part", [100_000, 3])
def test_places_of_all_patterns(spark, part, monkeypatch):
    monkeypatch.setattr(patterns, "PATTERNS", part)
    rnd = random.Random(1)
    texts = [(k, "".join(rnd.choice("abé \n") for _ in range(rnd.randrange(120)))) for k in range(40)] + [(50, None), (51, ""), (52, "🙂ab🙂ab"), (52, "a" * 60)]
    words = [(i, "".join(rnd.choice("abé ") for _ in range(rnd.randrange(1, 5)))) for i in range(15)] + [(20, ""), (21, None), (22, "a" * 16), (23, "a" * 17), (24, "a" * 20 + "b"), (25, "ab🙂"), (1, "ba"), (26, texts[3][1] or "x")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts], "doc_id long, text string, pattern string").repartition(3)
    table = spark.createDataFrame(words, "rule int, pattern string")
    got = sorted(map(tuple, patterns.find(docs, table, "doc_id", "rule").collect()))
    assert got == plain(texts, words) and len(got) > 300
    first = {}
    for i, k, a, b in got:
        first.setdefault((i, k), (a, b))
    once = patterns.find(docs.filter("doc_id <> 52"), table.filter("rule <> 1"), "doc_id", "rule", once=True).collect()
    assert {(r.rule, r.doc_id): (r.start, r.end) for r in once} == {x: y for x, y in first.items() if x[1] != 52 and x[0] != 1} and len(once) == len({(r.rule, r.doc_id) for r in once})


def test_no_patterns_and_no_texts(spark):
    docs, none = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "rule int, pattern string")
    assert patterns.find(docs, none, "doc_id", "rule").collect() == []
    assert patterns.find(docs.limit(0), spark.createDataFrame([(1, "a")], "rule int, pattern string"), "doc_id", "rule").collect() == []


def test_a_hundred_thousand_patterns(spark):
    """One pass, and no join in the plan."""
    rnd = random.Random(2)
    words = spark.range(100_000).select(F.col("id").alias("rule"), F.concat(F.lit("w"), F.md5(F.col("id").cast("string"))).alias("pattern"))
    texts = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("x "), F.concat(F.lit("w"), F.md5((F.col("id") * 300 + rnd.randrange(9)).cast("string"))), F.lit("y wabc")).alias("text"))
    found = patterns.find(texts, words, "doc_id", "rule")
    assert "Join" not in found._jdf.queryExecution().toString()
    assert found.select("doc_id").distinct().count() == 300 == found.count()


def vectors(rnd, n, dim, groups=12):
    middle = rnd.normal(size=(groups, dim)) * 3
    x = middle[rnd.integers(0, groups, n)] + rnd.normal(size=(n, dim))
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(5)
    found = vectors(rnd, 1200, 8) + [(i, [1.0] * 8) for i in range(1200, 1260)] + [(i, [0.0] * 8) for i in range(1260, 1264)]
    return found


def answers(frame):
    return sorted((r["query"], r["rank"], r.vec_id, round(r.score, 6)) for r in frame.collect())


def test_cells_give_the_nearest(spark, rows, tmp_path, monkeypatch):
    from lodestone.operators import vector_index

    monkeypatch.setattr(vector_index, "VECTORS", 40)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    odd = spark.createDataFrame([(2000, None), (2001, [1.0] * 7), (2002, [float("nan")] * 8), (None, [1.0] * 8), (5, [9.0] * 8)], "vec_id long, embedding array<double>")
    index = VectorIndex(spark, str(tmp_path), "m1", 8)
    asked = frame.filter("vec_id % 50 = 0 OR vec_id IN (1210, 1261)")
    assert index.search(asked, 5).count() == 0
    assert index.add(frame.filter("vec_id < 700")) == 700 and index.add(frame.unionByName(odd.filter("vec_id IS NOT NULL"))) == 564
    assert index.cells().agg(F.sum("n")).first()[0] == 1264  # every row is in a cell
    want = answers(search.knn(frame, asked, 10))
    assert answers(index.search(asked, 10, probes=3, exact=True)) == want
    near = {(q, v) for q, _, v, _ in answers(index.search(asked.filter("vec_id < 1200"), 10, probes=6))}
    true = {(q, v) for q, _, v, _ in want if q < 1200}
    assert len(near & true) >= 0.9 * len(true)
    assert index.rebuild(cells=5) == 1264 and index.cells().count() <= 5
    assert answers(index.search(asked, 10, probes=1, exact=True)) == want
    assert index.clean() > 0 and answers(index.search(asked, 10, probes=1, exact=True)) == want


def test_another_maker_or_size_begins_anew(spark, rows, tmp_path):
    frame = spark.createDataFrame(rows[:100], "vec_id long, embedding array<double>")
    assert VectorIndex(spark, str(tmp_path), "m1", 8).add(frame) == 100
    other = VectorIndex(spark, str(tmp_path), "m2", 8)
    assert other.search(frame, 3).count() == 0 and other.add(frame.limit(40)) == 40 and other.cells().agg(F.sum("n")).first()[0] == 40
    assert VectorIndex(spark, str(tmp_path), "m2", 9).add(frame) == 0


def test_few_neighbours_and_repeated_queries(spark, tmp_path):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    index = VectorIndex(spark, str(tmp_path), "m", 2)
    index.add(frame)
    got = answers(index.search(frame.unionByName(frame.filter("vec_id = 1")), 10, exact=True))
    assert got == sorted(2 * [(1, 1, 3, 0.707107), (1, 2, 2, 0.0)] + [(2, 1, 3, 0.707107), (2, 2, 1, 0.0), (3, 1, 1, 0.707107), (3, 2, 2, 0.707107)])
