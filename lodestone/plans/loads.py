"""Queries over loads: appends, updates, deletes, ids and reports of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import word_count
from lodestone.operators import ranking, relations
from lodestone.plans.registry import query
from lodestone.sources.tables import table


@query("""
    WITH e AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), n AS (SELECT count(*) AS inserted FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM e))
    SELECT count(*) AS found, any_value(inserted) AS inserted, count(*) - any_value(inserted) AS skipped FROM customer, n
""")
def insert_counts(spark: SparkSession, d: str) -> DataFrame:
    """All customers come in, those of one segment are there."""
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return relations.append_counted(rows.filter("c_mktsegment = 'BUILDING'"), rows, ["c_custkey"])[1]


@query("""
    WITH e AS (SELECT doc_id, text FROM documents WHERE lang = 'en')
    SELECT doc_id, source FROM documents d WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM e WHERE e.text = d.text)
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
""")
def insert_by_two_keys(spark: SparkSession, d: str) -> DataFrame:
    """Documents come in by id, each if neither its id nor its text is there yet; English ones are. Rows without a text are dropped. Ids are unique, so the first of each new text comes in."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "lang")
    there = docs.filter("lang = 'en'").select("doc_id", "text")
    return relations.insert_in_order(docs.filter("text <> ''"), there, ["doc_id", "text"], "doc_id").select("doc_id", "source")


@query("SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY s_suppkey) AS id, s_suppkey, s_name FROM supplier")
def append_with_ids(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers get the numbers after the last part's."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return relations.with_ids(rows, parts, "id", F.floor(F.col("s_suppkey") / 1000), F.col("s_suppkey"))


@query("""
    WITH c AS (SELECT l_orderkey, max(l_linestatus) || count(*) AS status FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
    SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN o_orderstatus ELSE status END AS o_orderstatus, l_orderkey IS NOT NULL AS changed FROM orders LEFT JOIN c ON l_orderkey = o_orderkey
""")
def update_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a returned line get a new status."""
    status = F.concat(F.max("l_linestatus"), F.count("*").cast("string"))
    changes = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(status.alias("o_orderstatus"))
    return relations.update(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), changes, "o_orderkey", ["o_orderstatus"])


@query("SELECT count(*) AS before, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-10') AS deleted FROM events")
def delete_counts(spark: SparkSession, d: str) -> DataFrame:
    return relations.deleted(table(spark, d, "events"), F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))[1]


@query("SELECT event_id, event_type FROM events WHERE NOT (event_type = 'error' AND value < 50)")
def delete_rows(spark: SparkSession, d: str) -> DataFrame:
    return relations.deleted(table(spark, d, "events"), F.expr("event_type = 'error' AND value < 50"))[0].select("event_id", "event_type")


@query("""
    WITH r AS (SELECT doc_id, CASE WHEN lang <> 'de' THEN lang END AS lang, CASE WHEN source = 'src0' THEN ' ' ELSE source END AS source FROM documents)
    SELECT r.doc_id AS doc_id, coalesce(r.lang, CAST(l.quality AS VARCHAR)) AS lang, CASE WHEN trim(r.source) = '' THEN coalesce(CAST(l.toxic AS VARCHAR), r.source) ELSE r.source END AS source
    FROM r LEFT JOIN labels l ON r.doc_id = l.doc_id
""")
def enrich_blanks(spark: SparkSession, d: str) -> DataFrame:
    """Only blank fields are filled from the other table."""
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") != "de", F.col("lang")).alias("lang"), F.when(F.col("source") == "src0", " ").otherwise(F.col("source")).alias("source"))
    other = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("lang"), F.col("toxic").cast("string").alias("source"))
    return relations.fill_blanks(rows, other, "doc_id", ["lang", "source"])


@query("SELECT len(embedding) AS dim, count(*) AS n, len(embedding) <> (SELECT max(len(embedding)) FROM embeddings) AS odd FROM embeddings GROUP BY len(embedding)")
def vector_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """How many vectors have each number of components, and which number isn't the largest: an index needs one."""
    sizes = table(spark, d, "embeddings").groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n"))  # a row for each number of components
    return sizes.crossJoin(F.broadcast(sizes.agg(F.max("dim").alias("most")))).select("dim", "n", (F.col("dim") != F.col("most")).alias("odd"))


@query("""
    SELECT s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS INTEGER) AS line, s_name, count(*) OVER (PARTITION BY s_nationkey) AS of FROM supplier
""")
def numbered_report(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a report: numbered in their section, with the section's total for its footer. A section is sorted in parts, by the beginnings of its names."""
    rows = table(spark, d, "supplier").select("s_nationkey", "s_name")
    totals = rows.groupBy("s_nationkey").agg(F.count("*").alias("of"))
    lines = ranking.positions(rows, ["s_nationkey"], F.substring("s_name", 1, 16), F.col("s_name"))
    return lines.join(totals, "s_nationkey").select("s_nationkey", F.col("position").cast("int").alias("line"), "s_name", "of")


@query("""
    SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS state, count(*) AS n,
           round(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 6) AS share, round(sum(CASE WHEN o_totalprice > 0 THEN o_totalprice ELSE 0 END), 2) AS total FROM orders GROUP BY ALL
""")
def status_progress(spark: SparkSession, d: str) -> DataFrame:
    """Counts, shares of all, and totals by state."""
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("other")
    counts = table(spark, d, "orders").groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.round(F.sum(F.greatest("o_totalprice", F.lit(0.0))), 2).alias("total"))
    every = counts.agg(F.sum("n").alias("every"))  # one row
    return counts.crossJoin(F.broadcast(every)).select("state", "n", F.round(F.try_divide("n", "every"), 6).alias("share"), "total")


@query(r"""
    SELECT count(*) AS found, count(*) FILTER (WHERE length(trim(text)) >= 50) AS parsed, count(*) FILTER (WHERE coalesce(length(trim(text)), 0) < 50) AS skipped,
           count(DISTINCT source) AS sections, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words FROM documents
""")
def ingest_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What a load of documents would report, in one pass."""
    size = F.coalesce(F.length(F.trim("text")), F.lit(0))
    return table(spark, d, "documents").agg(F.count("*").alias("found"), F.count_if(size >= 50).alias("parsed"), F.count_if(size < 50).alias("skipped"), F.countDistinct("source").alias("sections"), F.sum(word_count("text")).alias("words"))


@query("SELECT 'All' AS choice, count(*) AS n FROM documents UNION ALL SELECT 'fr', count(*) FROM documents WHERE lang = 'fr'")
def optional_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang")
    one, two = (relations.where_if(docs, "lang", x).agg(F.lit(x).alias("choice"), F.count("*").alias("n")) for x in ("All", "fr"))
    return one.unionByName(two)


@query("SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'gain' ELSE 'loss' END AS side, value FROM events WHERE event_type <> 'view'")
def two_sides(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a set and rows that are not in it, by a semi and an anti join with the set."""
    rows = table(spark, d, "events").filter("event_type <> 'view'").select("event_id", "event_type", "value")
    gains = F.broadcast(spark.createDataFrame([("purchase",), ("signup",)], "event_type string"))  # two rows
    sides = [rows.join(gains, "event_type", how).select("event_id", F.lit(side).alias("side"), "value") for how, side in (("left_semi", "gain"), ("left_anti", "loss"))]
    return sides[0].unionByName(sides[1])


@query("""
    WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
    SELECT CAST(i AS INTEGER) AS rank, CAST(p AS INTEGER) AS pos, o_orderkey FROM (SELECT unnest([3, 1, 900, 0, 25]) AS i, unnest([0, 1, 2, 3, 4]) AS p) JOIN r ON rank = i WHERE rank <= 25
""")
def rows_by_index(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a ranked list by a list of numbers from 1; numbers outside the list are dropped."""
    list_ = ranking.ranked(table(spark, d, "orders"), "o_orderkey", F.col("o_totalprice"), 25)
    asked = spark.range(1).select(F.posexplode(F.array(*map(F.lit, (3, 1, 900, 0, 25)))).alias("pos", "rank"))
    return asked.join(list_, "rank").select("rank", "pos", "o_orderkey")


@query("""
    WITH a AS (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer QUALIFY rank <= 3),
    o AS (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderkey) AS orders FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)
    SELECT c_nationkey, rank, c_custkey, coalesce(orders, '') AS orders FROM a LEFT JOIN o ON o_custkey = c_custkey
""")
def join_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """The first customers of each nation with the list of their pending orders."""
    first = ranking.top_per_group(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", 3, F.col("c_acctbal").desc(), F.col("c_custkey")).drop("c_acctbal")
    pending = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey").join(first.select("c_custkey"), "c_custkey", "left_semi")
    lists = pending.groupBy("c_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), " ").alias("orders"))
    return first.join(lists, "c_custkey", "left").select("c_nationkey", "rank", "c_custkey", F.coalesce("orders", F.lit("")).alias("orders"))


@query("SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + 7 * (1 + CAST(o_orderkey % 4 AS INTEGER)) AS DATE) AS VARCHAR) AS due FROM orders")
def weeks_ahead(spark: SparkSession, d: str) -> DataFrame:
    weeks = (1 + F.col("o_orderkey") % 4).cast("int")
    return table(spark, d, "orders").select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), weeks * 7).cast("string").alias("due"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 1) AS even FROM lineitem")
def round_half_even(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 4, 1).alias("even"))


@query("SELECT name, nation FROM (VALUES ('ASIA', 8), ('ATLANTIS', 1), ('LEMURIA', 2)) s(name, nation) WHERE name NOT IN (SELECT r_name FROM region)")
def seed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Fixed rows that the table doesn't have yet."""
    seeds = spark.createDataFrame([("ASIA", 8), ("ATLANTIS", 1), ("LEMURIA", 2)], "name string, nation int")
    return relations.new_rows(seeds, table(spark, d, "region").select(F.col("r_name").alias("name")), ["name"])


@query("""
    SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS kept, count(*) FILTER (WHERE l_returnflag = 'A') AS partly,
           round((count(*) FILTER (WHERE l_returnflag = 'N') + 0.5::DOUBLE * count(*) FILTER (WHERE l_returnflag = 'A')) / count(*), 6) AS rate FROM lineitem GROUP BY l_suppkey
""")
def outcome_rates(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes by supplier and their rate: a kept line counts whole, one kept in part a half, others only in the total."""
    counts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("kept"), F.count_if(F.col("l_returnflag") == "A").alias("partly"))
    return counts.withColumn("rate", F.round((F.col("kept") + F.lit(0.5) * F.col("partly")) / F.col("n"), 6))
