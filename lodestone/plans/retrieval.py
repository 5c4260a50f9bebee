"""Queries that find rows: many vectors, a kept text index, several probes, keywords and prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.vectors import hashed
from lodestone.operators import ranking, relations, search
from lodestone.plans.registry import query
from lodestone.sources.tables import table

_NORM = "sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * x)))"
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"
TERMS = ["the", "with", "und"]
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))
_DF = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(3))
_BM25 = " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * n / mean))" for i in range(3))


@query(f"""
    WITH q AS (SELECT vec_id AS query, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query, vec_id, round(list_sum(list_transform(list_zip(embedding, qe), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / ({_NORM.format('embedding')} * {_NORM.format('qe')}), 6) AS score FROM embeddings, q WHERE vec_id <> query)
    SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10
""")
def knn_many(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of every hundredth one (the stated set of queries) among all."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return search.knn(vectors, vectors.filter("vec_id % 100 = 0"), 10)


@query(f"""
    WITH t AS (SELECT doc_id, lang, {_TOKENS} AS w FROM documents), c AS (SELECT doc_id, lang, len(w) AS n, {_TF} FROM t), s AS (SELECT count(*) AS docs, avg(n) AS mean, {_DF} FROM c),
    r AS (SELECT doc_id, round({_BM25}, 6) AS score FROM c, s WHERE lang = 'en' AND tf0 + tf1 + tf2 > 0)
    SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r ORDER BY rank LIMIT 30
""")
def bm25_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best documents by an index of all terms; statistics are of all documents, the language is asked for afterwards."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    sizes = docs.select(F.size(tx.tokens("text")).alias("n")).agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    return search.search_index(search.postings(docs), sizes, TERMS, 30, docs.filter("lang = 'en'"))


@query("""
    WITH p AS (SELECT doc_id, text, source, lang, n_chars FROM documents), s AS (SELECT doc_id, n_chars, source AS probe, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM p),
    w AS (SELECT doc_id, n_chars, t AS probe, row_number() OVER (PARTITION BY t ORDER BY n_chars DESC, doc_id) AS k FROM p, (SELECT unnest(['tion', 'with', 'und']) AS t) WHERE contains(lower(text), t)),
    u AS (SELECT * FROM s WHERE k <= 20 UNION ALL SELECT * FROM w WHERE k <= 10)
    SELECT doc_id, any_value(n_chars) AS n_chars, string_agg(probe, ' ' ORDER BY probe) AS probes FROM u GROUP BY doc_id
""")
def multi_probe(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of every section and of every keyword, each once, with the probes that found it."""
    docs = table(spark, d, "documents")
    words = F.array(*map(F.lit, ("tion", "with", "und")))
    own = docs.select("doc_id", "n_chars", F.col("source").alias("probe"))
    met = docs.select("doc_id", "n_chars", F.explode(F.filter(words, lambda w: F.contains(F.lower("text"), w))).alias("probe"))
    best = [ranking.top_per_group(rows, "probe", k, F.col("n_chars").desc(), F.col("doc_id")) for rows, k in ((own, 20), (met, 10))]
    found = best[0].unionByName(best[1]).groupBy("doc_id").agg(F.first("n_chars").alias("n_chars"), F.array_sort(F.collect_list("probe")).alias("probes"))  # a row for each probe at most
    return found.select("doc_id", "n_chars", F.array_join("probes", " ").alias("probes"))


@query(f"""
    WITH b AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:3] AS words FROM (SELECT item_id, list_filter({_TOKENS}, lambda x: length(x) >= 4) AS w FROM benchmark)),
    t AS (SELECT doc_id, {_TOKENS} AS w FROM documents)
    SELECT item_id, doc_id FROM b JOIN t ON list_has_all(w, words) WHERE len(words) = 3
""")
def all_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have all of an item's first three keywords: the few keywords meet the documents' words, and three must."""
    items = table(spark, d, "benchmark").select("item_id", tx.keywords("text", 4, 3).alias("words")).filter("size(words) = 3")
    wanted = items.select("item_id", F.explode("words").alias("word"))
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tx.tokens("text"))).alias("word"))
    return words.join(relations.small(wanted), "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("n")).filter("n = 3").select("item_id", "doc_id")


@query("""
    SELECT b.item_id AS item_id, coalesce(min(d.doc_id), -1) AS doc_id, CASE WHEN min(d.doc_id) IS NULL THEN 0.0 ELSE 0.9 END AS certainty FROM benchmark b LEFT JOIN documents d ON contains(d.text, substr(b.text, 1, 60)) GROUP BY b.item_id
""")
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first document that holds the beginning of an item's text, or -1, and how certain that makes the item."""
    items = table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 60).alias("passage"))
    found = search.containing(table(spark, d, "documents").select("doc_id", "text"), items, "doc_id", "item_id").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    found = items.select("item_id").join(found, "item_id", "left").withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
    return found.withColumn("certainty", F.when(F.col("doc_id") < 0, 0.0).otherwise(0.9))


@query("""
    WITH e AS (SELECT DISTINCT l_partkey, l_returnflag, l_suppkey FROM lineitem WHERE l_returnflag IN ('R', 'A'))
    SELECT l_partkey AS part, l_returnflag AS kind, string_agg(CAST(l_suppkey AS VARCHAR), ' ' ORDER BY l_suppkey) AS neighbours FROM e GROUP BY l_partkey, l_returnflag
""")
def edge_lists(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of every node by kind of edge, in order."""
    edges = table(spark, d, "lineitem").filter(F.col("l_returnflag").isin("R", "A")).groupBy(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("kind"))
    return edges.agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")), " ").alias("neighbours"))


@query("""
    WITH e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), n AS (SELECT l_partkey, string_agg(s_name, ', ' ORDER BY s_name) AS suppliers, count(*) AS n FROM e JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey)
    SELECT p_partkey AS part, p_name AS name, p_type AS kind, p_size >= 25 AS large, coalesce(n, 0) AS n, coalesce(suppliers, '') AS suppliers FROM part LEFT JOIN n ON l_partkey = p_partkey
""")
def node_notes(spark: SparkSession, d: str) -> DataFrame:
    """Every node with its own fields and its neighbours by name; nodes without edges too."""
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    names = edges.join(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey").groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), ", ").alias("suppliers"), F.count("*").alias("n"))
    nodes = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size").join(names, "p_partkey", "left")
    return nodes.select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), (F.col("p_size") >= 25).alias("large"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("suppliers", F.lit("")).alias("suppliers"))


@query("""
    SELECT doc_id, array_to_string(list_filter([substr(text, 1, 40), substr(source, 1, 3), CASE WHEN lang <> '' THEN 'lang ' || lang END], lambda x: x IS NOT NULL AND trim(x) <> ''), ' ') AS asked,
           array_to_string(list_filter(['tion', 'with', 'that', 'from', 'this', 'ment', 'und', 'der', 'les', 'para'], lambda t: contains(lower(text), t))[1:8], ' ') AS terms FROM documents
""")
def query_texts(spark: SparkSession, d: str) -> DataFrame:
    """A query text from a row's fields, blank ones left out, and the first eight terms of a fixed vocabulary that it holds."""
    fields = F.array(F.substring("text", 1, 40), F.substring("source", 1, 3), F.when(F.col("lang") != "", F.concat(F.lit("lang "), F.col("lang"))))
    low = F.lower("text")
    vocabulary = F.array(*map(F.lit, ("tion", "with", "that", "from", "this", "ment", "und", "der", "les", "para")))
    asked = F.array_join(F.filter(fields, lambda x: x.isNotNull() & (F.trim(x) != "")), " ")
    return table(spark, d, "documents").select("doc_id", asked.alias("asked"), F.array_join(F.slice(F.filter(vocabulary, lambda t: F.contains(low, t)), 1, 8), " ").alias("terms"))


@query("""
    WITH l AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 60
        UNION ALL SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer WHERE c_mktsegment = 'MACHINERY' QUALIFY rank <= 40
        UNION ALL SELECT o_custkey, row_number() OVER (ORDER BY max(o_totalprice) DESC, o_custkey) AS rank FROM orders GROUP BY o_custkey QUALIFY rank <= 50)
    SELECT id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score FROM l GROUP BY id
""")
def rrf_many_lists(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of four ranked lists of different length: by balance, by balance within a segment, by the dearest order, and an empty one."""
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    dearest = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("most"))
    lists = [(customers, "c_acctbal", 60), (customers.filter("c_mktsegment = 'MACHINERY'"), "c_acctbal", 40), (dearest, "most", 50), (customers.filter("c_mktsegment = 'NONE'"), "c_acctbal", 10)]
    fused = ranking.rrf([ranking.ranked(rows, "c_custkey", F.col(by), k) for rows, by, k in lists], "c_custkey")
    return fused.select(F.col("c_custkey").alias("id"), F.round("rrf_score", 9).alias("rrf_score"))


@query("""
    WITH r AS (SELECT c_custkey, n_regionkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, CAST(row_number() OVER (ORDER BY CASE n_regionkey WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END, c_acctbal DESC, c_custkey) AS INTEGER) AS place FROM r ORDER BY place LIMIT 100
""")
def evidence_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows by a rank of their region, then by balance."""
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    region = F.when(F.col("n_regionkey") == 2, 0).when(F.col("n_regionkey") == 0, 1).otherwise(2)
    first = ranking.ranked(rows, "c_custkey", F.struct((-region).alias("region"), "c_acctbal"), 100)
    return first.select("c_custkey", F.col("rank").alias("place"))


@query(f"""
    WITH w AS (SELECT doc_id, unnest({_TOKENS}) AS word FROM documents), c AS (SELECT doc_id, CAST(('0x' || substr(md5(word), 1, 2)) AS INTEGER) % 64 AS bucket, count(*) AS n FROM w GROUP BY ALL)
    SELECT doc_id, bucket, round(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY doc_id) AS DOUBLE)), 6) AS weight FROM c
""")
def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A unit vector of 64 components for every text, of its words' hashed counts; components that aren't zero. Counts are merged before they are shuffled."""
    words = table(spark, d, "documents").select("doc_id", F.explode(tx.tokens("text")).alias("word"))
    counts = words.groupBy("doc_id", hashed("word", 64).alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n").cast("double") * F.col("n")).over(Window.partitionBy("doc_id")))  # 64 rows at most
    return counts.select("doc_id", "bucket", F.round(F.col("n") / norm, 6).alias("weight"))


@query(f"""
    WITH p AS (SELECT DISTINCT item_id FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 60))),
    b AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:3] AS words FROM (SELECT item_id, list_filter({_TOKENS}, lambda x: length(x) >= 4) AS w FROM benchmark)),
    k AS (SELECT DISTINCT item_id FROM b JOIN (SELECT {_TOKENS} AS w FROM documents) t ON list_has_all(w, words) WHERE len(words) = 3)
    SELECT item_id, CASE WHEN item_id IN (FROM p) THEN 'passage' WHEN item_id IN (FROM k) THEN 'words' ELSE 'none' END AS by, CASE WHEN item_id IN (FROM p) THEN 0.9 WHEN item_id IN (FROM k) THEN 0.75 ELSE 0.0 END::DOUBLE AS certainty FROM benchmark
""")
def verified_in_steps(spark: SparkSession, d: str) -> DataFrame:
    """How an item is verified: its beginning stands in a document, or else its first words all do, or else it is not."""
    passages = prefix_lookup(spark, d).select("item_id", F.when(F.col("doc_id") >= 0, "passage").alias("one"))
    words = all_keywords(spark, d).select("item_id").distinct().withColumn("two", F.lit("words"))
    by = F.coalesce("one", "two", F.lit("none"))
    found = passages.join(words, "item_id", "left").select("item_id", by.alias("by"))
    return found.withColumn("certainty", F.when(F.col("by") == "passage", 0.9).when(F.col("by") == "words", 0.75).otherwise(0.0))


@query("""
    SELECT doc_id, CAST(CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])with([^a-z0-9]|$)') THEN 4 ELSE 0 END + contains(lower(text), 'tion')::INT + contains(lower(text), 'und')::INT
           + CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 ELSE 1 END + CASE WHEN n_chars >= 1000 THEN 2 WHEN n_chars >= 300 THEN 1 ELSE 0 END AS INTEGER) AS score FROM documents
""")
def relevance_points(spark: SparkSession, d: str) -> DataFrame:
    """Points for a whole word, for each term, for a language and for a size, as one expression over the scan."""
    low = F.lower("text")
    word = F.when(low.rlike("(^|[^a-z0-9])with([^a-z0-9]|$)"), 4).otherwise(0)
    terms = sum((F.coalesce(F.contains(low, F.lit(t)), F.lit(False)).cast("int") for t in ("tion", "und")), F.lit(0))
    lang = F.when(F.col("lang") == "en", 3).when(F.col("lang") == "de", 2).otherwise(1)
    size = F.when(F.col("n_chars") >= 1000, 2).when(F.col("n_chars") >= 300, 1).otherwise(0)
    return table(spark, d, "documents").select("doc_id", (word + terms + lang + size).alias("score"))


@query(f"""
    WITH t AS (SELECT doc_id, text, {_TOKENS} AS w FROM documents), c AS (SELECT doc_id, text, len(w) AS n, {_TF} FROM t), s AS (SELECT count(*) AS docs, avg(n) AS mean, {_DF} FROM c),
    q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 5),
    one AS (SELECT doc_id, row_number() OVER (ORDER BY round({_BM25}, 6) DESC, doc_id) AS rank FROM c, s WHERE tf0 + tf1 + tf2 > 0 QUALIFY rank <= 50),
    two AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE contains(lower(text), 'tion') QUALIFY rank <= 50),
    v AS (SELECT vec_id AS doc_id, round(list_sum(list_transform(list_zip(embedding, qe), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / ({_NORM.format('embedding')} * {_NORM.format('qe')}), 6) AS score FROM embeddings, q),
    three AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM v QUALIFY rank <= 50),
    f AS (SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score FROM (FROM one UNION ALL FROM two UNION ALL FROM three) GROUP BY doc_id ORDER BY rrf_score DESC, doc_id LIMIT 20)
    SELECT f.doc_id AS doc_id, rrf_score, lang, source FROM f LEFT JOIN documents d ON d.doc_id = f.doc_id
""")
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Three ranked lists (terms, a keyword, a vector) fused, and the rows of what is found."""
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    terms = search.bm25(docs.select("doc_id", "text"), TERMS).select("doc_id", F.round("score", 6).alias("score"))
    near = search.neighbours(vectors, vectors.filter("vec_id = 5")).select(F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score"))
    keyword = docs.filter(F.lower("text").contains("tion")).select("doc_id", F.col("n_chars").alias("score"))
    fused = ranking.rrf([ranking.ranked(x, "doc_id", F.col("score"), 50) for x in (terms, keyword, near)], "doc_id")
    best = fused.select("doc_id", F.round("rrf_score", 9).alias("rrf_score")).orderBy(F.col("rrf_score").desc(), "doc_id").limit(20)
    return docs.select("doc_id", "lang", "source").join(F.broadcast(best), "doc_id", "right").select("doc_id", "rrf_score", "lang", "source")  # 20 rows


@query(f"""
    WITH w AS (SELECT doc_id, lang, unnest(list_distinct({_TOKENS})) AS term FROM documents)
    SELECT term, count(*) AS df, count(*) FILTER (WHERE lang IS DISTINCT FROM 'en') AS added FROM w GROUP BY term
""")
def index_sync(spark: SparkSession, d: str) -> DataFrame:
    """An index of the English documents takes up the others; in how many documents each term then is, and how many of these came in."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    index = search.postings(docs.filter("lang = 'en'"))
    every = index.withColumn("came", F.lit(0)).unionByName(search.new_postings(index, docs).withColumn("came", F.lit(1)))
    return every.groupBy("term").agg(F.count("*").alias("df"), F.sum("came").alias("added"))
