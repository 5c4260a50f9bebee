"""Queries of the library over the test tables, and SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.vectors import cosine
from lodestone.operators import ranking, relations, search
from lodestone.plans import kept, loads, mining, retrieval, streams  # noqa: F401  they register their queries
from lodestone.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from lodestone.plans.views import cases, evidence
from lodestone.sources.tables import table

#: A time that stands for now in every report.
NOW = "2024-01-20 00:00:00"
TERMS = ["tion", "with", "that", "from", "this"]


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('fr', 'de') AND n_chars > 500")
def scan_filter_project(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("lang IN ('fr', 'de') AND n_chars > 500").select("doc_id", "lang", "n_chars")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_orderstatus", "o_totalprice").limit(1)


@query("""
    SELECT id, court, year, CAST(row_number() OVER (PARTITION BY section ORDER BY CASE court WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END, year DESC, id) AS INTEGER) AS rank, section
    FROM {cases} c WHERE verified IN (1, 2) QUALIFY row_number() OVER (PARTITION BY section ORDER BY CASE court WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END, year DESC, id) <= 5
""")
def court_rank_order(spark: SparkSession, d: str) -> DataFrame:
    rows = cases(spark, d, win=False).filter(F.col("verified").isin(1, 2)).select("id", "court", "year", "section")
    court = F.when(F.col("court") == "A", 0).when(F.col("court") == "B", 1).otherwise(2)
    return ranking.top_per_group(rows, "section", 5, court, F.col("year").desc(), F.col("id"))


@query("SELECT id, section, court FROM {cases} c WHERE contains(lower(text), 'ation') OR contains(lower(section), 'src1')")
def multi_col_contains(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d, win=False).filter(F.lower("text").contains("ation") | F.lower("section").contains("src1")).select("id", "section", "court")


@query("""
    SELECT section, count(*) AS total, count(*) FILTER (WHERE court = 'A') AS court_a, count(*) FILTER (WHERE court = 'B') AS court_b,
           count(*) FILTER (WHERE court NOT IN ('A', 'B')) AS others FROM {cases} c GROUP BY section
""")
def coverage_pivot(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("court")
    return cases(spark, d, win=False).groupBy("section").agg(F.count("*").alias("total"), F.count_if(c == "A").alias("court_a"), F.count_if(c == "B").alias("court_b"), F.count_if(~c.isin("A", "B")).alias("others"))


@query("SELECT section, court, count(*) AS n FROM {cases} c WHERE section <> '' GROUP BY section, court ORDER BY n DESC, section, court LIMIT 50")
def two_key_top50(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d, win=False).filter("section <> ''").groupBy("section", "court").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "section", "court").limit(50)


@query("SELECT coalesce(lang, 'none') AS lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY coalesce(lang, 'none')")
def source_breakdown_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("SELECT section, count(*) AS n, round(100.0 * avg(win), 4) AS share FROM {cases} c WHERE win IS NOT NULL GROUP BY section")
def section_share(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).filter("win IS NOT NULL").groupBy("section").agg(F.count("*").alias("n"), F.round(F.avg("win") * 100, 4).alias("share"))


@query("""
    SELECT count(*) AS rows_all, count(*) FILTER (WHERE status = 'available') AS available, count(*) FILTER (WHERE mandatory) AS mandatory, count(DISTINCT case_id) AS cases FROM {evidence} e
""")
def dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).agg(F.count("*").alias("rows_all"), F.count_if(F.col("status") == "available").alias("available"), F.count_if("mandatory").alias("mandatory"), F.countDistinct("case_id").alias("cases"))


@query("""
    SELECT n.n_name AS name, count(o.o_orderkey) AS orders, CASE WHEN count(o.o_orderkey) = 0 THEN 'gap' WHEN count(o.o_orderkey) < 20 THEN 'partial' ELSE 'covered' END AS coverage
    FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' GROUP BY n.n_name
""")
def coverage_with_zero_groups(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    counts = table(spark, d, "customer").join(orders, "c_custkey").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("k").alias("k"))
    n = F.coalesce("k", F.lit(0))
    coverage = F.when(n == 0, "gap").when(n < 20, "partial").otherwise("covered")
    return table(spark, d, "nation").join(counts, "n_nationkey", "left").select(F.col("n_name").alias("name"), n.alias("orders"), coverage.alias("coverage"))


@query(f"""
    SELECT event_type AS source, count(*) AS total, count(*) FILTER (WHERE ts + INTERVAL 7 DAY > TIMESTAMP '{NOW}') AS active, count(*) FILTER (WHERE ts + INTERVAL 7 DAY <= TIMESTAMP '{NOW}') AS expired
    FROM events GROUP BY event_type
""")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    alive = F.col("ts") + F.expr("INTERVAL 7 DAYS") > F.lit(NOW).cast("timestamp_ntz")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("total"), F.count_if(alive).alias("active"), F.count_if(~alive).alias("expired"))


_HITS = " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN 1 ELSE 0 END" for t in TERMS)
_NORM = "sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * x)))"


@query(f"""
    WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY h DESC, doc_id) AS rank FROM (SELECT doc_id, {_HITS} AS h FROM documents) QUALIFY rank <= 100),
    q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0),
    s AS (SELECT vec_id AS doc_id, round(list_sum(list_transform(list_zip(embedding, qe), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / ({_NORM.format('embedding')} * {_NORM.format('qe')}), 6) AS v FROM embeddings, q),
    b AS (SELECT doc_id, row_number() OVER (ORDER BY v DESC, doc_id) AS rank FROM s QUALIFY rank <= 100)
    SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id ORDER BY rrf_score DESC, doc_id LIMIT 10
""")
def rrf_two_lists(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    hits = sum((F.when(low.contains(t), 1).otherwise(0) for t in TERMS), F.lit(0))
    a = ranking.ranked(table(spark, d, "documents"), "doc_id", hits, 100)
    vectors = table(spark, d, "embeddings")
    asked = vectors.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)  # one row
    near = vectors.crossJoin(F.broadcast(asked)).select(F.col("vec_id").alias("doc_id"), F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("v"))
    b = ranking.ranked(near, "doc_id", F.col("v"), 100)
    fused = ranking.rrf([a, b], "doc_id").select("doc_id", F.round("rrf_score", 9).alias("rrf_score"))
    return fused.orderBy(F.col("rrf_score").desc(), "doc_id").limit(10)


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")
def best_per_key(spark: SparkSession, d: str) -> DataFrame:
    return ranking.best_per_key(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", "c_custkey")


@query("SELECT text, doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return ranking.first_per_key(table(spark, d, "documents").select("text", "doc_id", "source"), ["text"], "doc_id")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(row_number() OVER w AS INTEGER) AS rank FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) QUALIFY row_number() OVER w <= 25")
def topk_per_bucket(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_per_group(table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), "o_orderpriority", 25, F.col("o_totalprice").desc(), F.col("o_orderkey"))


@query("""
    WITH t AS (SELECT doc_id, 0 AS tier FROM documents WHERE lang = 'es' UNION ALL SELECT doc_id, 1 FROM documents WHERE n_chars > 3000 UNION ALL SELECT doc_id, 2 FROM documents)
    SELECT doc_id, CAST(min(tier) AS INTEGER) AS tier FROM t GROUP BY doc_id ORDER BY tier, doc_id LIMIT 300
""")
def waterfall_fill(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return ranking.waterfall([docs.filter(c).select("doc_id") for c in ("lang = 'es'", "n_chars > 3000", "true")], "doc_id", 300, F.col("doc_id")).select("doc_id", "tier")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def anti_new_rows(spark: SparkSession, d: str) -> DataFrame:
    bought = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return relations.new_rows(table(spark, d, "customer"), bought, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def semi_lookup(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(large, "p_partkey", "left_semi").select("p_partkey", "p_brand")


@query("""
    SELECT section, name, count(*) AS total, count(*) FILTER (WHERE outcome = 'accepted') AS accepted, count(*) FILTER (WHERE outcome = 'rejected') AS rejected, count(*) FILTER (WHERE outcome = 'partial') AS partial
    FROM {evidence} e WHERE outcome IS NOT NULL GROUP BY section, name
""")
def feedback_stats(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("outcome")
    return evidence(spark, d).filter(o.isNotNull()).groupBy("section", "name").agg(F.count("*").alias("total"), *[F.count_if(o == k).alias(k) for k in ("accepted", "rejected", "partial")])


@query("""
    SELECT CAST(l AS BIGINT) AS doc_id, CAST(p AS INTEGER) AS pos, d.lang AS lang FROM (SELECT unnest([5, 3, 8, 1, 100]) AS l, unnest([0, 1, 2, 3, 4]) AS p) JOIN documents d ON d.doc_id = l
""")
def lookup_in_order(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.range(1).select(F.array(*[F.lit(x).cast("long") for x in (5, 3, 8, 1, 100)]).alias("ids"))
    return relations.in_order(ids, table(spark, d, "documents").select("doc_id", "lang"), "doc_id")


@query("""
    SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Events up to a day are there, those from then on come in."""
    e = table(spark, d, "events").withColumn("version", F.struct("ts", "event_id")).select("user_id", "event_id", "event_type", "value", "version", "ts")
    late = F.col("ts") >= F.lit(NOW).cast("timestamp_ntz")
    return relations.upsert(e.filter(~late).drop("ts"), e.filter(late).drop("ts"), "user_id", "version").drop("version")


@query("SELECT s_suppkey, s_name, 'open' AS status, CAST(0 AS INTEGER) AS boost FROM supplier")
def schema_evolve(spark: SparkSession, d: str) -> DataFrame:
    return relations.evolve(table(spark, d, "supplier").select("s_suppkey", "s_name"), {"status": "open", "boost": 0})


@query("""
    WITH e AS (SELECT * FROM {evidence} x), g AS (SELECT case_id, max(CASE WHEN status = 'available' AND section = 'purchase' THEN 1 ELSE 0 END) AS some FROM e GROUP BY case_id)
    SELECT e.id, e.case_id, e.section FROM e JOIN g ON e.case_id = g.case_id WHERE (e.status = 'available' AND e.section = 'purchase') OR g.some = 0
""")
def section_filter_fallback(spark: SparkSession, d: str) -> DataFrame:
    return relations.with_fallback(evidence(spark, d), "case_id", "status = 'available' AND section = 'purchase'").select("id", "case_id", "section")


@query("""
    WITH s AS (SELECT o_orderkey AS query, CAST(0 AS BIGINT) AS pos, o_custkey AS node FROM orders),
    e AS (SELECT l_partkey AS src, l_returnflag AS kind, min(l_orderkey) AS pos, l_suppkey + 1000000000000 AS dst FROM lineitem GROUP BY l_partkey, l_returnflag, l_suppkey),
    f AS (SELECT query, node, 0 AS step, pos AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM s
          UNION ALL SELECT s.query, e.dst, 1, s.pos, CASE e.kind WHEN 'R' THEN 1 ELSE 2 END, e.pos FROM s JOIN e ON e.src = s.node WHERE e.kind IN ('R', 'A')),
    m AS (SELECT query, node, min({'step': step, 'a': a, 'b': b, 'c': c}) AS place_at FROM f GROUP BY query, node)
    SELECT query, node, CAST(row_number() OVER (PARTITION BY query ORDER BY place_at, node) AS INTEGER) AS place FROM m
""")
def graph_expand(spark: SparkSession, d: str) -> DataFrame:
    """From every order along the typed edges of parts to suppliers; a customer's number stands for the part that it asks about."""
    starts = table(spark, d, "orders").select(F.col("o_orderkey").alias("query"), F.lit(0).alias("pos"), F.col("o_custkey").alias("node"))
    items = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_returnflag").alias("kind"), (F.col("l_suppkey") + 1_000_000_000_000).alias("dst"), F.col("l_orderkey").alias("pos"))
    edges = items.repartition("src").groupBy("src", "kind", "dst").agg(F.min("pos").alias("pos"))  # by src, as all that follows is
    return relations.expand_graph(starts, edges, ["R", "A"])


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(("the", "with", "und")))
_DF = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(3))
_BM25 = " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * n / mean))" for i in range(3))


@query(f"""
    WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, {_TF} FROM t), s AS (SELECT count(*) AS docs, avg(n) AS mean, {_DF} FROM c)
    SELECT doc_id, round({_BM25}, 6) AS score FROM c, s WHERE tf0 > 0 OR tf1 > 0 OR tf2 > 0
""")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), ["the", "with", "und"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""
    WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 3)
    SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, qe), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / ({_NORM.format('embedding')} * {_NORM.format('qe')}), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 20
""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    near = search.neighbours(vectors, vectors.filter("vec_id = 3")).select("vec_id", F.round("score", 6).alias("score"))
    return near.orderBy(F.col("score").desc(), "vec_id").limit(20)


@query("""
    SELECT doc_id, CAST((CASE WHEN contains(lower(text), 'heon') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(source), 'heon') THEN 5 ELSE 0 END)
        + (CASE WHEN contains(lower(text), 'src3') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(source), 'src3') THEN 5 ELSE 0 END) AS INTEGER) AS score FROM documents
    WHERE contains(lower(text), 'heon') OR contains(lower(source), 'heon') OR contains(lower(text), 'src3') OR contains(lower(source), 'src3')
""")
def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword_score(table(spark, d, "documents"), ["heon", "src3"], {"text": 2, "source": 5}, "doc_id")


@query(r"""
    SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages
""")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.strip_html("html").alias("body"))


@query(r"SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def first_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", tx.first_year(F.concat(F.lit("no 12345 of "), F.col("o_orderdate").cast("string"))).alias("year"))


@query("""
    SELECT doc_id, array_to_string(list_slice(list_distinct_first, 1, 8), ' ') AS words FROM (
        SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_first FROM (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 4 AND x NOT IN ('that', 'with')) AS w FROM documents))
""")
def keyword_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.keywords("text", 4, 8, ["that", "with"]), " ").alias("words"))


@query("""
    WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'k, ' || event_type || ' ,, z' WHEN 1 THEN '["k", "' || event_type || '"]' WHEN 2 THEN '["k", ' || event_type WHEN 3 THEN ' ' END AS raw FROM events)
    SELECT event_id, coalesce(array_to_string(CASE WHEN json_valid(raw) AND raw LIKE '[%' THEN json_transform(CASE WHEN json_valid(raw) THEN raw END, '["VARCHAR"]')
        ELSE list_filter(list_transform(string_split(trim(raw), ','), lambda x: trim(x)), lambda x: x <> '') END, '|'), '') AS listed FROM r
""")
def parse_list_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Lists with commas, as JSON, as broken JSON, blank and null."""
    k, kind = F.col("event_id") % 5, F.col("event_type")
    raw = F.when(k == 0, F.concat(F.lit("k, "), kind, F.lit(" ,, z"))).when(k == 1, F.concat(F.lit('["k", "'), kind, F.lit('"]'))).when(k == 2, F.concat(F.lit('["k", '), kind)).when(k == 3, F.lit(" "))
    return table(spark, d, "events").select("event_id", F.array_join(tx.parse_list(raw), "|").alias("listed"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).filter("k IS NOT NULL")


@query("SELECT c_custkey, substr(sha256('8:customer' || CASE WHEN c_mktsegment = 'BUILDING' THEN '-' ELSE length(trim(lower(c_name))) || ':' || trim(lower(c_name)) END), 1, 40) AS key FROM customer")
def stable_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", tx.stable_key(F.lit("Customer "), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name"))).alias("key"))


@query(f"""
    SELECT o_orderkey, date_diff('day', DATE '2024-01-20', CAST(o_orderdate AS DATE) + 60) AS days_left,
           CASE WHEN date_diff('day', DATE '2024-01-20', CAST(o_orderdate AS DATE) + 60) < 0 THEN 'late' WHEN date_diff('day', DATE '2024-01-20', CAST(o_orderdate AS DATE) + 60) < 30 THEN 'soon' ELSE 'open' END AS state FROM orders
""")
def deadline_status(spark: SparkSession, d: str) -> DataFrame:
    left = F.date_diff(F.date_add(F.col("o_orderdate").cast("date"), 60), F.lit("2024-01-20").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", left.cast("long").alias("days_left"), F.when(left < 0, "late").when(left < 30, "soon").otherwise("open").alias("state"))


@query("""
    SELECT o_orderkey, step, CAST(CAST(CAST(o_orderdate AS DATE) + CAST(days AS INTEGER) AS DATE) AS VARCHAR) AS due FROM orders, (SELECT unnest(['open', 'check', 'close']) AS step, unnest([0, 7, 30]) AS days)
""")
def timeline_plan(spark: SparkSession, d: str) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(n).alias("days")) for s, n in (("open", 0), ("check", 7), ("close", 30))])
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.explode(steps).alias("s"))
    return rows.select("o_orderkey", "s.step", F.date_add(F.col("o_orderdate").cast("date"), F.col("s.days")).cast("string").alias("due"))


_REDACT = "text"
for _kind, _pattern in tx.REDACTIONS:
    _REDACT = f"regexp_replace({_REDACT}, '{_pattern}', '[{_kind.upper()}]', 'g')"


@query(f"SELECT doc_id, {_REDACT} AS clean FROM documents")
def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.redact("text").alias("clean"))


_PASSES, _COUNTS = ["text AS t0"], []
for _i, (_kind, _pattern) in enumerate(tx.REDACTIONS):
    _PASSES.append(f"regexp_replace(t{_i}, '{_pattern}', '[{_kind.upper()}]', 'g') AS t{_i + 1}")
    _COUNTS.append(f"CAST(sum(len(regexp_extract_all(t{_i}, '{_pattern}'))) AS BIGINT) AS {_kind}")


@query(f"SELECT {', '.join(_COUNTS)}, count(*) AS docs FROM (SELECT {', '.join(_PASSES)} FROM documents)")
def pii_counts(spark: SparkSession, d: str) -> DataFrame:
    kinds = [F.sum(f"r.{kind}").alias(kind) for kind, _ in tx.REDACTIONS]
    return table(spark, d, "documents").select(tx.redactions("text").alias("r")).agg(*kinds, F.count("*").alias("docs"))


@query("SELECT conv_id, turn, role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations")
def next_line_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("reply"))


@query("SELECT DISTINCT b.item_id AS item_id, d.doc_id AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def passage_verify(spark: SparkSession, d: str) -> DataFrame:
    """Which documents hold a benchmark passage whole: all passages are sought in one pass over the texts."""
    passages = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    return search.containing(table(spark, d, "documents").select("doc_id", "text"), passages, "doc_id", "item_id")


@query("""
    SELECT user_id, CAST((k - 1) // 50 AS BIGINT) AS page, string_agg(event_type, ',' ORDER BY k) AS types
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) GROUP BY user_id, (k - 1) // 50
""")
def group_to_list(spark: SparkSession, d: str) -> DataFrame:
    """The event types of each user in order, as lists in pages of fifty, so that no user is one row, however active."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    placed = ranking.positions(rows, ["user_id"], F.date_trunc("hour", "ts"), F.col("ts"), F.col("event_id"))
    listed = F.array_sort(F.collect_list(F.struct("position", "event_type")))
    pages = placed.groupBy("user_id", F.floor((F.col("position") - 1) / 50).alias("page"))
    return pages.agg(F.array_join(F.transform(listed, lambda x: x["event_type"]), ",").alias("types"))


@query("""
    WITH b AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags, list(DISTINCT l_linestatus || l_returnflag) AS marks FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, array_to_string(list_sort(flags), '') AS flags, array_to_string(list_sort(list_intersect(marks, ['OA', 'FR', 'ON'])), ' ') AS common, list_has_any(flags, ['R']) AS returned, len(marks) AS n_marks FROM b
""")
def array_set_operations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"), F.collect_set(F.concat("l_linestatus", "l_returnflag")).alias("marks"))
    some = F.array(F.lit("OA"), F.lit("FR"), F.lit("ON"))
    return rows.select("l_orderkey", F.array_join(F.array_sort("flags"), "").alias("flags"), F.array_join(F.array_sort(F.array_intersect("marks", some)), " ").alias("common"), F.array_contains("flags", "R").alias("returned"), F.size("marks").cast("long").alias("n_marks"))


@query("""
    SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity * (1 - l_discount)) AS BIGINT) AS whole, greatest(least(l_extendedprice, 50000.0), 2000.0) AS clamped FROM lineitem
""")
def floor_and_clamp(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.floor(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("whole"), tx.clamp("l_extendedprice", 2000.0, 50000.0).alias("clamped"))


@query("SELECT p_partkey, coalesce(CASE WHEN contains(p_type, 'BRASS') THEN 'brass' END, CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END, 'plain') AS kind FROM part")
def first_success(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce(F.when(F.col("p_type").contains("BRASS"), "brass"), F.when(F.col("p_size") > 40, "large"), F.when(F.col("p_retailprice") > 1500, "dear"), F.lit("plain"))
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"))


@query(f"SELECT event_id, user_id FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '{NOW}'")
def delete_expired(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(F.col("ts") + F.expr("INTERVAL 7 DAYS") > F.lit(NOW).cast("timestamp_ntz")).select("event_id", "user_id")


@query("SELECT d.doc_id AS doc_id, d.lang AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR d.text = ''")
def null_or_empty(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.filter(F.col("quality").isNull() | (F.col("text") == "")).select("doc_id", "lang")


@query("SELECT n.n_name AS nation, r.r_name AS region, count(c.c_custkey) AS customers, round(coalesce(sum(c.c_acctbal), 0), 2) AS balance FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, r.r_name")
def enrich_and_total(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("s"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.join(sums, "n_nationkey", "left").select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.coalesce("n", F.lit(0)).alias("customers"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("balance"))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, max(turn) AS longest, round(avg(length(text)), 4) AS mean_chars FROM conversations GROUP BY role")
def role_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.max("turn").alias("longest"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))
