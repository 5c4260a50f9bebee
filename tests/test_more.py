"""Edges of the operators behind the load, text and retrieval queries, and the driver entry without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.vectors import hashed
from lodestone.operators import ranking, relations, search
from lodestone.sources.tables import feed_items, headed, text_files
from lodestone.streaming.sync import run_to_table, windowed_counts

ROOT = Path(__file__).resolve().parent.parent


def one(spark, column, *values):
    """``column`` of x for each value."""
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").coalesce(1).select(column).collect()]


def test_entry_without_optional_parts(tmp_path):
    """In a copy without the training-data folders, with and without corpus_pipeline.py, the entry loads and its other queries are there."""
    for name in ("lodestone", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name) if (ROOT / name).exists() else None
    shutil.rmtree(tmp_path / "lodestone/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(s) <= set(q) and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); print('fine')"
    for _ in range(2):
        run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
        assert run.stdout == "fine\n", run.stderr
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, tx.ellipsis(x, 5), "abcde", "abcdef", "", None) == ["abcde", "ab...", "", None]
    assert one(spark, tx.masked(x), "ab", "abcd", "abcdef", "", None) == ["**", "****", "**cdef", "", None]
    assert one(spark, tx.url_part(x), "a b+*~/é", "", None) == ["a%20b%2B%2A~%2F%C3%A9", "", None]
    assert one(spark, tx.word_count(x), " a\tb\n c ", "", None) == [3, 0, 0]
    assert one(spark, tx.page_count(x), "a\fb\f", "", None) == [3, 1, 1]
    assert one(spark, tx.plain_reply(x), "```json\n{}\n```", " x ", "a ``` b", None) == ["{}", "x", "a ``` b", None]
    assert one(spark, tx.words_of_slug(x), "http://x/a/some-long_slug/?q=1", "http://x/", None) == ["Some Long Slug", "X", None]
    assert one(spark, tx.numbers(x, r"\b([0-9]{1,4})\b", 1, 299), "0 7 300 7 12345 299", "", None) == [[7, 299], [], None]
    assert one(spark, tx.first_amount(x, [r"of ([0-9,.]+)"], 100), "of 12, of 1,234.50", "of ,", None) == [1234.5, None, None]
    assert one(spark, tx.paragraphs(x, 3), "abcd\n \nab\n\n efgh ", "", None) == [["abcd", "efgh"], [], None]
    assert one(spark, tx.hits(x, ["a", "b$"], 2), "aab", "abc", "", None) == [2, 0, 0, 0]
    assert one(spark, tx.first_label(x, [("one", ["A"]), ("two", ["b"])], "none"), "xa", "B", "", None) == ["one", "two", "none", "none"]
    assert one(spark, tx.rule_labels(x, [("p", "^a"), ("q", "b"), ("p", "c")]), "cab", "", None) == [["q", "p"], [], []]
    assert one(spark, tx.references(x, ["[0-9]+", "[a-z]+"], 2), "ab 12 ab 3 c", "", None) == [["12", "ab"], [], []]
    assert one(spark, tx.abbreviated(x.cast("double")), "0.9", "-0.5", "999.9", "-1000", "1999.9", "1234567", "-25000000", None) == ["0", "0", "999", "-1.0K", "1.9K", "1.2M", "-25.0M", None]
    assert one(spark, tx.plain_name(x), " Mr. Dr A  B, and others.", "Drake & Others", "and others", "", None) == ["A B", "Drake", "", "", None]
    assert one(spark, hashed(x, 256), "a", "", None) == [0x0C, 0xD4, None]
    keys = one(spark, tx.stable_key("x", F.lit(None).cast("string")), "A ", "a", "a-", None) + one(spark, tx.stable_key(F.lit(None).cast("string"), "x"), "a")
    assert keys[0] == keys[1] and len(set(keys)) == 4 and all(len(k) == 40 for k in keys)


def test_positions_are_places_in_the_group(spark):
    rows = [(g, t) for g in (None, "a", "b") for t in (None, *range(0, 250, 7))]
    placed = ranking.positions(spark.createDataFrame(rows, "g string, t int").repartition(5), ["g"], F.floor(F.col("t") / 50), F.col("t"))
    got = {(r.g, r.t): r.position for r in placed.collect()}
    assert got == {(g, t): k + 1 for g in (None, "a", "b") for k, t in enumerate([None, *range(0, 250, 7)])}


def test_loads(spark):
    there = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    coming = spark.createDataFrame([(2, "x"), (3, "y"), (3, "y"), (4, " ")], "id long, v string")
    fresh, counts = relations.append_counted(there, coming, ["id"])
    assert sorted(r.id for r in fresh.collect()) == [3, 4] and tuple(counts.first()) == (4, 2, 2)
    empty = there.limit(0)
    assert tuple(relations.append_counted(empty, empty, ["id"])[1].first()) == (0, 0, 0)
    ids = relations.with_ids(coming.select("v").distinct(), empty, "id", F.length("v"), F.col("v"))
    assert {r.v: r.id for r in ids.collect()} == {" ": 1, "x": 2, "y": 3}
    changed = relations.update(there, spark.createDataFrame([(2, None), (9, "z")], "id long, v string"), "id", ["v"])
    assert sorted(map(tuple, changed.collect())) == [(1, "a", False), (2, None, True)]
    left, counts = relations.deleted(there, F.col("v") == "a")
    assert [r.id for r in left.collect()] == [2] and tuple(counts.first()) == (2, 1)
    filled = relations.fill_blanks(coming.distinct(), spark.createDataFrame([(4, "new"), (2, "no")], "id long, v string"), "id", ["v"])
    assert sorted(map(tuple, filled.collect())) == [(2, "x"), (3, "y"), (4, "new")]
    groups = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("b", 2)], "g string, v int")
    assert sorted(str(tuple(r)) for r in relations.with_fallback(groups, "g", "v = 1").collect()) == ["('a', 1)", "('b', 2)", "(None, 1)"]
    assert relations.where_if(there, "v", None).count() == 2 and relations.where_if(there, "v", "a").count() == 1


def test_knn_blocks_and_odd_vectors(spark):
    rows = [(i, [float(i % 7), float(i % 5) - 2, 1.0]) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, None), (62, [1.0, None, 2.0]), (63, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")

    def cosine(a, b):
        p = sum(x * y for x, y in zip(a, b, strict=True))
        n = (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
        return round(p / n, 6) if n else 0.0

    usable = dict(r for r in rows[:61])
    want = {q: sorted(((-cosine(usable[q], x), i) for i, x in usable.items() if i != q))[:5] for q in (0, 7, 60)}
    got = {q: [] for q in want}
    for r in search.knn(vectors, vectors.filter("vec_id IN (0, 7, 60, 61, 62, 63)"), 5, rows=16).orderBy("rank").collect():
        got[r.query].append((-r.score, r.vec_id))
    assert {q: [(round(s, 5), i) for s, i in x] for q, x in got.items()} == {q: [(round(s, 5), i) for s, i in x] for q, x in want.items()}
    assert search.knn(vectors.limit(0), vectors, 5).count() == 0


def test_index_is_kept_and_searched(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, ""), (4, None), (5, "a")], "doc_id long, text string")
    search.write_index(docs, str(tmp_path))
    index, sizes = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("postings", "sizes"))
    kept = search.search_index(index, sizes, ["a", "zzz"], 5).collect()
    direct = {r.doc_id: round(r.score, 6) for r in search.bm25(docs.filter("text IS NOT NULL"), ["a"]).collect()}
    assert [r.doc_id for r in kept] == sorted(direct, key=lambda i: (-direct[i], i)) and len(direct) == 2
    assert [r.doc_id for r in search.search_index(index, sizes, ["a"], 5, docs.filter("doc_id = 1")).collect()] == [1]
    assert search.search_index(index, sizes, ["none"], 5).count() == 0


def test_feeds_and_files(spark, tmp_path):
    feed = "<rss><item><title>a &amp;lt; b</title><link/></item><item><title><![CDATA[x &amp; y]]></title></item></rss>"
    rows = feed_items(spark.createDataFrame([(1, feed), (2, None), (3, "")], "id long, xml string")).collect()
    assert [(r.id, r.pos, r.title, r.link) for r in rows] == [(1, 0, "a &lt; b", None), (1, 1, "x &amp; y", None)]
    for name, text in (("b", "long enough"), ("a", "long enough too"), ("c", "no")):
        (tmp_path / f"{name}.txt").write_text(text)
    assert [r.path[-5:] for r in text_files(spark, str(tmp_path), 5, 1).collect()] == ["a.txt"]
    assert text_files(spark, str(tmp_path)).count() == 3


def test_joined_lines(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("a", 4, "w."), ("a", 5, "v"), ("b", 1, "q."), ("b", 2, None), ("b", 3, "r"), (None, 1, "s"), (None, 2, "t.")]
    lines = spark.createDataFrame(rows, "g string, k int, t string")
    got = relations.joined_lines(lines, "g", "k", "t", ~F.col("t").endswith(".")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("a", 1, "x y"), ("a", 3, "z w."), ("a", 5, "v"), ("b", 1, "q."), ("b", 2, None), ("b", 3, "r"), (None, 1, "s t.")]))
    assert relations.joined_lines(lines.limit(0), "g", "k", "t", F.lit(True)).count() == 0


def test_redacted_values_and_heads(spark):
    values = one(spark, tx.redacted_values(F.col("x")), "a@b.org 10.0.0.1 c@d.org", "", None)
    assert [[(v.kind, v.pos, v.value) for v in row] for row in values] == [[("email", 0, "a@b.org"), ("email", 1, "c@d.org"), ("ip", 0, "10.0.0.1")], [], []]
    heads = one(spark, headed(F.col("x"), "URL", "DATE"), "URL: u\nTITLE:\n\nbody\n\nDATE: no", "no head\nDATE: d", "", None)
    assert [(h.url, h.date, h.body) for h in heads] == [("u", None, "body\n\nDATE: no"), (None, None, "no head\nDATE: d"), (None, None, ""), (None, None, None)]


def test_index_takes_new_documents_only(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b"), (3, ""), (None, "c"), (4, None)], "doc_id long, text string")
    index = search.postings(docs.filter("doc_id = 1"))
    assert sorted((r.term, r.doc_id) for r in search.new_postings(index, docs.filter("doc_id IS NOT NULL")).collect()) == [("b", 2)]
    assert search.new_postings(search.postings(docs), docs.filter("doc_id < 3")).count() == 0
    assert search.new_postings(search.postings(docs.limit(0)), docs.filter("doc_id = 1")).count() == 2


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 01:10:00"), (None, "2024-01-01 02:00:00"), ("a", "2024-01-01 03:30:00"), ("a", None)]
    spark.createDataFrame(rows, "k string, t string").selectExpr("k", "cast(t as timestamp) as t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
    got = run_to_table(windowed_counts(stream, "t", "1 hour", "1 hour", "k"), spark, "test").collect()
    assert sorted((str(r.start)[11:13], str(r.k), r.n) for r in got) == [("00", "a", 2), ("01", "b", 1)]


def test_redacted_values_after_each_other_and_texts_searched_once(spark, small):
    """Later patterns see what earlier ones left, as in redact(); the report reads what was found, not the texts again."""
    from lodestone.plans.catalog import QUERIES

    values = one(spark, tx.redacted_values(F.col("x")), "x +49 170 1234567 y a@1.2.3.4 10.0.0.1 1234 5678 9012 3456", "no @ here", "a@b.org_c@d.org")
    assert [[(v.kind, v.pos, v.value) for v in row] for row in values] == [
        [("email", 0, "a@1.2.3.4"), ("ip", 0, "10.0.0.1"), ("card", 0, "1234 5678 9012 3456"), ("phone", 0, "+49 170 1234567")],
        [],
        [("email", 0, "a@b.org"), ("email", 1, "_c@d.org")],
    ]
    assert not [f for f in QUERIES["redaction_report"](spark, small).inputFiles() if "documents.parquet" in f]
