import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import ranking, relations, search
from lodestone.sources.tables import feed_items, header_field, text_files
from lodestone.streaming.sync import append_new


def test_rrf_sums_and_order(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    got = {r.id: r.rrf_score for r in ranking.rrf([a, b], "id").collect()}
    assert set(got) == {1, 2, 3}
    assert abs(got[2] - (1 / 61 + 1 / 62)) < 1e-9 and got[2] > got[1] > got[3]
    assert ranking.rrf([a.limit(0), b.limit(0)], "id").count() == 0
    assert {r.id: r.rrf_score for r in ranking.rrf([b, a], "id").collect()} == got


def test_parse_list(spark):
    rows = spark.createDataFrame([('["a", "b"]',), ("a, b,",), ("",), (None,)], "v string")
    assert [r.x for r in rows.select(tx.parse_list("v").alias("x")).collect()] == [["a", "b"], ["a", "b"], [], []]


def test_loose_json(spark):
    replies = ['Here: {"a": [1, 2], "b": [3]} done', "```json\n[1, 2]\n```", "no json", "{broken", "", None, '{"a": [1, {"b": "}"}]} or {"c": 2} end', 'x [1, [2]] and [3] {"d": 4}', "{x} {y}"]
    rows = spark.createDataFrame([(r,) for r in replies], "v string")
    assert [r.x for r in rows.select(tx.loose_json("v").alias("x")).collect()] == ['{"a": [1, 2], "b": [3]}', "[1, 2]", None, None, None, None, '{"a": [1, {"b": "}"}]}', "[1, [2]]", None]


def test_redaction_is_idempotent_and_counts_by_pass(spark):
    rows = spark.createDataFrame([("mail a.b@c.org or 10.0.0.1, call +1 555-123-4567, card 4111 1111 1111 1111",), (None,), ("",)], "t string")
    once = rows.select(tx.redact("t").alias("t"), tx.redactions("t").alias("n"))
    first = once.first()
    assert first.t == "mail [EMAIL] or [IP], call [PHONE], card [CARD]"
    assert first.n.asDict() == {"email": 1, "ip": 1, "card": 1, "phone": 1}
    assert [r.t for r in once.select(tx.redact("t").alias("t")).collect()] == [r.t for r in once.collect()]


def test_html_year_and_keywords(spark):
    row = spark.createDataFrame([("<p>In 2021 <b>alpha</b> met</p><script>x()</script> beta beta",)], "h string")
    got = row.select(tx.strip_html("h").alias("t")).select("t", tx.first_year("t").alias("y"), tx.keywords("t", 4).alias("k")).first()
    assert (got.t, got.y, got.k) == ("In 2021 alpha met beta beta", 2021, ["2021", "alpha", "beta"])


def test_feed_items(spark):
    xml = "<rss><item><title><![CDATA[One]]></title><link>u1</link></item><item><title>Two</title><pubDate>d</pubDate></item></rss>"
    got = feed_items(spark.createDataFrame([(7, xml), (8, "")], "feed int, xml string")).orderBy("pos").collect()
    assert [(r.feed, r.pos, r.title, r.link, r.published) for r in got] == [(7, 0, "One", "u1", None), (7, 1, "Two", None, "d")]


def test_text_files_with_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text("URL: http://x\nTITLE: One\n\nbody " + "w " * 50)
    (tmp_path / "b.txt").write_text("short")
    got = text_files(spark, str(tmp_path), least_chars=20).select(header_field("text", "TITLE").alias("t"), header_field("text", "DATE").alias("d")).collect()
    assert [(r.t, r.d) for r in got] == [("One", None)]


def test_new_rows_by_two_keys_and_upsert(spark):
    old = spark.createDataFrame([("a", "u1", 1), ("b", "u2", 1)], "name string, url string, v int")
    new = spark.createDataFrame([("a", "u9", 2), ("c", "u2", 2), ("d", "u4", 2), (None, "u5", 2)], "name string, url string, v int")
    assert sorted(r.url for r in relations.new_rows(new, old, ["name", "url"]).collect()) == ["u4", "u5"]
    assert {(r.name, r.url) for r in relations.upsert(old, new.filter("name is not null"), "name", "v").collect()} == {("a", "u9"), ("b", "u2"), ("c", "u2"), ("d", "u4")}


def test_graph_keeps_starts_and_unknown_nodes(spark):
    starts = spark.createDataFrame([(1, 0, "x"), (1, 1, "nowhere")], "query int, pos int, node string")
    edges = spark.createDataFrame([("x", "near", 1, "z"), ("x", "near", 0, "y"), ("x", "far", 0, "x"), ("x", "other", 0, "q")], "src string, kind string, pos int, dst string")
    got = relations.expand_graph(starts, edges, ["far", "near"]).orderBy("place").collect()
    assert [r.node for r in got] == ["x", "nowhere", "y", "z"]


def test_bm25_prefers_rare_terms_and_short_texts(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common other"), (3, "nothing here"), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r.score for r in search.bm25(docs, ["common", "rare"]).collect()}
    assert set(got) == {1, 2} and got[1] > got[2] > 0


def test_fallback_keeps_groups_without_a_match(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None)], "g int, v string")
    assert {(r.g, r.v) for r in relations.with_fallback(rows, "g", "v = 'a'").collect()} == {(1, "a"), (2, "c"), (3, None)}


def test_append_new_is_idempotent(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string").write.parquet(source)
    for k in range(2):
        stream = spark.readStream.schema("id int, v string").parquet(source)
        append_new(stream, target, "id", str(tmp_path / f"state{k}")).awaitTermination()
    assert spark.read.parquet(target).count() == 2


def test_clamp_and_waterfall(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert [r.x for r in rows.select(tx.clamp(F.col("id"), 1.5, 2.5).alias("x")).collect()] == [1.5, 2.0, 2.5]
    got = ranking.waterfall([rows.filter("id = 3"), rows], "id", 2, F.col("id")).collect()
    assert [(r.id, r.tier) for r in got] == [(3, 0), (1, 1)]


def test_first_seen_drops_repeats_within_the_watermark(spark, tmp_path):
    from lodestone.streaming.sync import first_seen

    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("b", "2024-01-01 00:06:00")]
    spark.createDataFrame(rows, "k string, t string").selectExpr("k", "cast(t as timestamp) as t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
    run = first_seen(stream, "k", "t", "10 minutes").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.k for r in spark.table("seen").collect()) == ["a", "b"]


def test_best_and_first_per_key(spark):
    rows = spark.createDataFrame([("x", 1, 5.0), ("x", 2, 5.0), ("y", 3, None), ("y", 4, 1.0)], "g string, id long, s double")
    assert {(r.g, r.id) for r in ranking.best_per_key(rows, ["g"], "s", "id").collect()} == {("x", 1), ("y", 4)}
    assert {(r.g, r.id) for r in ranking.first_per_key(rows, ["g"], "id").collect()} == {("x", 1), ("y", 3)}


def test_lookup_keeps_list_order_and_repeats(spark):
    ids = spark.createDataFrame([([3, 1, 3, 9],)], "ids array<long>")
    rows = spark.createDataFrame([(1, "a"), (3, "c")], "id long, v string")
    assert [(r.pos, r.v) for r in relations.in_order(ids, rows, "id").orderBy("pos").collect()] == [(0, "c"), (1, "a"), (2, "c")]


def test_graph_against_a_loop_and_without_a_shuffle_of_what_is_found(spark):
    """Queries with one start and with several, kinds that tie, nodes that lead to themselves, a null neighbour; one start a query needs no shuffle behind the join."""
    rnd = random.Random(3)
    edges = [(rnd.randrange(12), rnd.choice("abz"), rnd.randrange(4), rnd.choice([*range(12), None])) for _ in range(150)]
    starts = [(q, p, rnd.randrange(14)) for q in range(30) for p in range(1 if q < 15 else rnd.randrange(1, 4))]
    want = []
    for q in range(30):
        at = {}
        for _, p, node in (s for s in starts if s[0] == q):
            for n, place in [(node, (0, p, 0, 0)), *((d, (1, p, "ba".index(k) + 1, c)) for s, k, c, d in edges if s == node and k in "ba")]:
                at[n] = min(at.get(n, place), place)
        want += [(q, n, i) for i, n in enumerate(sorted(at, key=lambda n: (at[n], n is not None, n or 0)), 1)]
    frames = spark.createDataFrame(starts, "query int, pos int, node int"), spark.createDataFrame(edges, "src int, kind string, pos int, dst int")
    got = relations.expand_graph(*frames, ["b", "a"])
    assert sorted(map(str, got.select("query", "node", "place").collect())) == sorted(str(spark_row) for spark_row in [Row(query=q, node=n, place=p) for q, n, p in want])
    plan = relations.expand_graph(frames[0].filter("query < 15"), frames[1], ["b", "a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("Exchange")
