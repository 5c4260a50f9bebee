"""Queries over what is kept: tables that are loaded and changed, indexes in parts, counters and entries of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import patterns, relations, sparse
from lodestone.operators.text_index import TextIndex
from lodestone.operators.vector_index import VectorIndex
from lodestone.plans.registry import query
from lodestone.plans.retrieval import _NORM, _TF, _TOKENS, TERMS
from lodestone.plans.streams import stream_of
from lodestone.sources.files import files, load_files
from lodestone.sources.stored import Stored
from lodestone.sources.tables import table
from lodestone.sources.versions import new_folder
from lodestone.streaming import state, sync

URGENT = ["1-URGENT", "2-HIGH"]


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _loaded(spark: SparkSession, d: str) -> tuple[Stored, list[dict[str, int]]]:
    """A table of orders: closed ones, then urgent ones in their place or besides, then a status for returns, then without the cheap ones."""
    rows, target = _orders(spark, d), Stored(spark, new_folder(spark, "orders"), "o_orderkey", buckets=8)
    steps = [target.insert(rows.filter("o_orderstatus <> 'O'"))]
    steps.append(target.upsert(rows.filter(F.col("o_orderpriority").isin(URGENT)).withColumn("o_orderstatus", F.lit("X"))))
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    steps.append(target.update(returned.withColumn("o_orderstatus", F.lit("R")), ["o_orderstatus"]))
    steps.append({"deleted": target.delete(F.col("o_totalprice") < 50_000)})
    return target, steps


_LOADED = """
    WITH r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), u AS (SELECT *, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent FROM orders),
    t AS (SELECT o_orderkey, CASE WHEN l_orderkey IS NOT NULL THEN 'R' WHEN urgent THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM u LEFT JOIN r ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O' OR urgent)
"""


@query(_LOADED + "SELECT * FROM t WHERE o_totalprice >= 50000")
def stored_loads(spark: SparkSession, d: str) -> DataFrame:
    """A stored table after an insert, an upsert, an update and a delete, each of which wrote the buckets it touched."""
    return _loaded(spark, d)[0].read().select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""
    WITH u AS (SELECT *, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent FROM orders), r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), t AS (SELECT * FROM u WHERE o_orderstatus <> 'O' OR urgent)
    SELECT 1 AS step, count(*) AS found, 0 AS errors, count(*) AS inserted, 0 AS updated, 0 AS skipped, 0 AS deleted FROM u WHERE o_orderstatus <> 'O'
    UNION ALL SELECT 2, count(*), 0, count(*) FILTER (WHERE o_orderstatus = 'O'), count(*) FILTER (WHERE o_orderstatus <> 'O'), 0, 0 FROM u WHERE urgent
    UNION ALL SELECT 3, count(*), 0, 0, count(*) FILTER (WHERE l_orderkey IN (SELECT o_orderkey FROM t)), count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM t)), 0 FROM r
    UNION ALL SELECT 4, 0, 0, 0, 0, 0, count(*) FROM t WHERE o_totalprice < 50000
""")
def load_counts(spark: SparkSession, d: str) -> DataFrame:
    """What each load of stored_loads() counted while it ran."""
    names = ["found", "errors", "inserted", "updated", "skipped", "deleted"]
    return spark.createDataFrame([(i, *(s.get(n, 0) for n in names)) for i, s in enumerate(_loaded(spark, d)[1], 1)], ", ".join(f"{n} long" for n in ["step", *names]))


def _bm25(terms: dict[str, str], docs: str = "docs", mean: str = "mean") -> str:
    return " + ".join(f"{w} * ln(1 + ({docs} - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * n / {mean}))" for i, w in terms.items())


_THREE = _bm25({"0": "1", "1": "1", "2": "1"})
_SUMS = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(3))


@query(f"""
    WITH c AS (SELECT doc_id, len(w) AS n, {_TF} FROM (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE source <> 'src3')), s AS (SELECT count(*) AS docs, avg(n) AS mean, {_SUMS} FROM c),
    r AS (SELECT doc_id, round({_THREE}, 6) AS score FROM c, s WHERE tf0 + tf1 + tf2 > 0)
    SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r ORDER BY rank LIMIT 30
""")
def bm25_segments(spark: SparkSession, d: str) -> DataFrame:
    """The best documents by an index that came in three parts, of which two were merged, without one source that was taken out again."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    index = TextIndex(spark, new_folder(spark, "index"))
    for some in (docs.filter("lang = 'en'"), docs.filter("lang IN ('en', 'de')"), docs):
        index.add(some)
    index.remove(docs.filter("source = 'src3'"))
    index.merge(2)
    return index.search(TERMS, 30).select("doc_id", "score", "rank")


@query(f"""
    WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, {_TF} FROM t), s AS (SELECT count(*) AS docs, avg(n) AS mean, {_SUMS} FROM c),
    b AS (SELECT doc_id, round({_THREE}, 6) AS score FROM c, s WHERE tf0 + tf1 + tf2 > 0 ORDER BY score DESC, doc_id LIMIT 10),
    p AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t), f AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
    h AS (SELECT term, round(sum(tf / n * score / (SELECT sum(score) FROM b)), 9) AS w FROM f JOIN b USING (doc_id) GROUP BY term ORDER BY w DESC, term LIMIT 10),
    q AS (SELECT term, sum(w) AS w FROM (SELECT term, 0.5::DOUBLE * w / (SELECT sum(w) FROM h) AS w FROM h UNION ALL SELECT unnest({TERMS}), 0.5::DOUBLE / 3) GROUP BY term),
    d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    r AS (SELECT doc_id, round(sum(w * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / mean))), 6) AS score FROM f JOIN q USING (term) JOIN d USING (term), s GROUP BY doc_id)
    SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r ORDER BY rank LIMIT 20
""")
def bm25_feedback(spark: SparkSession, d: str) -> DataFrame:
    """The best documents for a query that was widened by the heaviest terms of its ten best documents."""
    index = TextIndex(spark, new_folder(spark, "index"))
    index.rebuild(table(spark, d, "documents").select("doc_id", "text"))
    return index.search(index.expanded(TERMS, feedback=10, terms=10, share=0.5), 20).select("doc_id", "score", "rank")


@query("""
    WITH m AS (SELECT item_id, doc_id, b.text AS p, d.text AS t FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    s AS (SELECT item_id, doc_id, p, t, unnest(range(1, length(t) - length(p) + 2)) AS i FROM m)
    SELECT item_id, doc_id, CAST(i - 1 AS INTEGER) AS start, CAST(i - 1 + length(p) AS INTEGER) AS end FROM s WHERE substr(t, i, length(p)) = p
""")
def passage_places(spark: SparkSession, d: str) -> DataFrame:
    """Every place at which a benchmark passage stands in a document."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("pattern"))
    return patterns.find(table(spark, d, "documents").select("doc_id", "text"), items, "doc_id", "item_id")


@query(f"""
    WITH q AS (SELECT vec_id AS query, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query, vec_id, round(list_sum(list_transform(list_zip(embedding, qe), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / ({_NORM.format('embedding')} * {_NORM.format('qe')}), 6) AS score FROM embeddings, q WHERE vec_id <> query)
    SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10
""")
def knn_by_cells(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of every hundredth one (the stated set of queries) by an index of cells, with those that could hold a nearer one."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    dim = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    index = VectorIndex(spark, new_folder(spark, "cells"), "table embeddings", dim)
    index.add(vectors)
    return index.search(vectors.filter("vec_id % 100 = 0"), 10, probes=4, exact=True)


@query(f"""
    WITH p AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    r AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS raw FROM f JOIN d USING (term)), v AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM r),
    s AS (SELECT q.doc_id AS query, v.doc_id AS doc_id, round(sum(q.w * v.w), 6) AS score FROM v AS q JOIN v ON v.term = q.term AND v.doc_id <> q.doc_id WHERE q.doc_id % 100 = 0 GROUP BY ALL)
    SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s QUALIFY rank <= 10
""")
def nearest_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts nearest to every hundredth one (the stated set of queries) by their words' weights, among all."""
    vectors = sparse.tfidf(table(spark, d, "documents").select("doc_id", "text"))
    return sparse.top_k(vectors, vectors.filter("doc_id % 100 = 0"), 10)


@query(None)  # each row depends on all that came in before it; tests hold it against doing so
def insert_one_by_one(spark: SparkSession, d: str) -> DataFrame:
    """Orders that come in one by one, each only if neither its customer nor its day is taken yet; the open ones of low priority are there."""
    rows = _orders(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day")), "o_orderkey")
    there = F.expr("o_orderstatus = 'O' AND o_orderpriority = '5-LOW'")
    return relations.insert_in_order(rows.filter(~there), rows.filter(there), ["o_custkey", "day"], "o_orderkey").select("o_orderkey", "o_custkey", "day")


@query("SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY source")
def text_file_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Texts written to files in a folder for each source, then loaded from there: their characters, line ends too."""
    folder = new_folder(spark, "texts")
    table(spark, d, "documents").select("source", "text").write.partitionBy("source").text(folder)
    loaded = Stored(spark, f"{folder}-loaded", "path", buckets=8)
    load_files(files(spark, folder), loaded)
    own = loaded.read().select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), F.length("text").cast("long").alias("n"))
    return own.groupBy("source").agg(F.sum("n").alias("chars"))


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and user, counted by a stream that puts what changed into a stored table."""
    place = new_folder(spark, "counts")
    counts = Stored(spark, f"{place}/table", "id", buckets=8)
    state.running_counts(stream_of(spark, d, "events"), ["event_type", "user_id"], counts, "counts", f"{place}/state").awaitTermination()
    return counts.read().select("event_type", "user_id", "n")


@query("""
    WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
    s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS z, count(*) AS n FROM g GROUP BY user_id, k)
    SELECT CAST(user_id AS VARCHAR) AS key, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(z, '%Y-%m-%d %H:%M:%S') AS end, n FROM s WHERE z <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR
""")
def stream_expired(spark: SparkSession, d: str) -> DataFrame:
    """Users' entries, which live for six hours after the last event, as they expire in a stream."""
    events = stream_of(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    with state.store(spark):
        out = sync.run_to_table(state.expired(events, "user_id", "ts", 6 * 3600, "2 hours"), spark, "expired")
    return out.select("key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")
