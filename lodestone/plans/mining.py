"""Queries over text: what is found in it, counted, labelled, shortened and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import patterns, ranking, relations
from lodestone.plans.registry import query
from lodestone.sources.tables import about, feed_items, headed, table
from lodestone.sources.versions import new_folder, written


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS short FROM documents")
def ellipsis(spark: SparkSession, d: str) -> DataFrame:
    return docs_of(spark, d).select("doc_id", tx.ellipsis("text", 40).alias("short"))


@query("SELECT page_id, url_encode(url || '?q=a b*~é&' || html) AS encoded FROM pages")
def url_encoded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.url_part(F.concat("url", F.lit("?q=a b*~é&"), "html")).alias("encoded"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS words, CAST(len(regexp_extract_all(replace(text, '. ', chr(12)), '\f')) + 1 AS INTEGER) AS pages FROM documents")
def word_and_page_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pages end at form feeds; here ends of sentences stand for them."""
    return docs_of(spark, d).select("doc_id", tx.word_count("text").alias("words"), tx.page_count(F.replace("text", F.lit(". "), F.lit("\f"))).alias("pages"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END AS masked FROM customer")
def masked_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", tx.masked("c_name").alias("masked"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{\"' || event_type || '\": 1}' WHEN 1 THEN event_type ELSE 'a ``` b' END AS reply FROM events")
def clean_reply(spark: SparkSession, d: str) -> DataFrame:
    k, kind = F.col("event_id") % 3, F.col("event_type")
    raw = F.when(k == 0, F.concat(F.lit('```json\n{"'), kind, F.lit('": 1}\n```\n'))).when(k == 1, F.concat(F.lit("\n "), kind, F.lit(" \n"))).otherwise("a ``` b")
    return table(spark, d, "events").select("event_id", tx.plain_reply(raw).alias("reply"))


@query("""
    WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{"a": [' || event_id || ', 2]}' WHEN 2 THEN '[{"a": ' || event_id || '}]' END AS reply FROM events)
    SELECT event_id, CASE WHEN json_valid(reply) THEN reply END AS found FROM r
""")
def lenient_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON in plain and fenced replies, behind other words, an object that holds arrays and an array that holds objects; broken, empty and null replies give null."""
    k, n = F.col("event_id") % 6, F.col("event_id").cast("string")
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    reply = reply.when(k == 1, F.concat(F.lit('Here it is: {"a": ['), n, F.lit(", 2]} and so on"))).when(k == 2, F.concat(F.lit('[{"a": '), n, F.lit("}]")))
    reply = reply.when(k == 3, F.concat(F.lit('{"a": ['), n)).when(k == 4, F.lit(""))
    return table(spark, d, "events").select("event_id", tx.loose_json(reply).alias("found"))


@query("""SELECT doc_id, '["' || source || '","' || lang || '"]' AS listed, '{"lang":"' || lang || '","n":' || n_chars || '}' AS object FROM documents""")
def json_encode(spark: SparkSession, d: str) -> DataFrame:
    return docs_of(spark, d).select("doc_id", F.to_json(F.array("source", "lang")).alias("listed"), F.to_json(F.struct("lang", F.col("n_chars").alias("n"))).alias("object"))


@query("""
    WITH r AS (SELECT page_id, ['short', replace(replace(replace(html, '"', ' '), '\\', ' '), '<', ' '), url] AS parts FROM pages)
    SELECT page_id, list_extract(list_sort(list_filter(parts, lambda x: length(x) = list_max(list_transform(parts, lambda y: length(y))))), 1) AS body FROM r
""")
def longest_embedded_body(spark: SparkSession, d: str) -> DataFrame:
    """Of the JSON objects embedded in a page's scripts, the longest articleBody (of equally long ones the least)."""
    body = F.replace(F.replace(F.replace("html", F.lit('"'), F.lit(" ")), F.lit("\\"), F.lit(" ")), F.lit("<"), F.lit(" "))
    script = [F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(x.alias("articleBody"))), F.lit("</script>")) for x in (F.lit("short"), body, F.col("url"))]
    page = F.concat(F.lit("<p>x</p>"), *script)
    found = F.regexp_extract_all(page, F.lit(r'(?s)<script type="application/ld\+json">(.*?)</script>'), 1)
    bodies = F.array_compact(F.transform(found, lambda x: F.get_json_object(x, "$.articleBody")))
    best = F.array_min(F.transform(bodies, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("body"))))["body"]
    return table(spark, d, "pages").select("page_id", best.alias("body"))


@query("SELECT doc_id FROM documents WHERE list_contains(['SRC3', 'X', upper(lang)], upper(source)) OR list_contains(['SRC5', 'X', upper(lang)], 'FR')")
def json_membership(spark: SparkSession, d: str) -> DataFrame:
    """Membership in a list written as JSON, whatever the case of its letters."""
    listed = F.transform(F.from_json(F.concat(F.lit('["src3", "x", "'), F.col("lang"), F.lit('"]')), "array<string>"), lambda x: F.upper(x))
    return docs_of(spark, d).filter(F.array_contains(listed, F.upper("source")) | F.array_contains(listed, "FR")).select("doc_id")


@query("""
    SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_type LIKE 'PROMO%' THEN 'promo' END, CASE WHEN regexp_matches(p_type, 'BRASS|COPPER') OR contains(p_type, 'STEEL') THEN 'red' END,
               CASE WHEN contains(p_type, 'A') THEN 'a' END], lambda x: x IS NOT NULL), ' ') AS labels,
           CASE WHEN contains(lower(p_type), 'tin') OR contains(lower(p_type), 'nickel') THEN 'grey' WHEN contains(lower(p_type), 'small') THEN 'small' ELSE 'other' END AS label FROM part
""")
def labels_by_rules(spark: SparkSession, d: str) -> DataFrame:
    """All labels of a table of patterns, and the first of a table of words."""
    labels = tx.rule_labels("p_type", [("promo", "^PROMO"), ("red", "BRASS|COPPER"), ("red", "STEEL"), ("a", "A")])
    label = tx.first_label("p_type", [("grey", ["TIN", "nickel"]), ("small", ["small"])], "other")
    return table(spark, d, "part").select("p_partkey", F.array_join(labels, " ").alias("labels"), label.alias("label"))


@query(r"""
    SELECT o_orderkey, CASE WHEN o_totalprice > 1000 THEN CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS DOUBLE) WHEN o_custkey % 1000 > 100 THEN CAST(o_custkey % 1000 AS DOUBLE) END AS amount FROM orders
""")
def first_amount(spark: SparkSession, d: str) -> DataFrame:
    """The first amount over a bound, of the first pattern that finds one."""
    note = F.concat(F.lit("fee 12.50, total of "), F.format_number(F.col("o_totalprice"), 2), F.lit(" or sum "), (F.col("o_custkey") % 1000).cast("string"), F.lit("."))
    amount = F.coalesce(tx.first_amount(note, [r"total of ([0-9,]+(?:\.[0-9]+)?)"], 1000), tx.first_amount(note, [r"fee ([0-9.]+),", r"sum ([0-9]+)"], 100))
    return table(spark, d, "orders").select("o_orderkey", amount.alias("amount"))


@query(r"SELECT doc_id, array_to_string(list_distinct_first, ' ') AS found FROM (SELECT doc_id, list_filter(n, lambda x, i: list_position(n, x) = i) AS list_distinct_first FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\b([0-9]{1,4})\b', 1), lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 299) AS n FROM documents))")
def bounded_numbers(spark: SparkSession, d: str) -> DataFrame:
    found = tx.numbers("text", r"\b([0-9]{1,4})\b", 1, 299)
    return docs_of(spark, d).select("doc_id", F.array_join(F.transform(found, lambda x: x.cast("string")), " ").alias("found"))


@query("SELECT doc_id, CAST(len(list_filter(list_transform(string_split(replace(text, '. ', chr(10) || chr(10)), chr(10) || chr(10)), lambda p: trim(p)), lambda p: length(p) > 60)) AS INTEGER) AS n, list_filter(list_transform(string_split(replace(text, '. ', chr(10) || chr(10)), chr(10) || chr(10)), lambda p: trim(p)), lambda p: length(p) > 60)[1] AS first FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)")
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    """Long paragraphs; sentences stand for them."""
    text = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(". "), F.lit("\n\n"))
    found = tx.paragraphs(text, 60)
    return docs_of(spark, d).select("doc_id", F.size(found).alias("n"), F.try_element_at(found, F.lit(1)).alias("first"))


@query(r"""
    WITH s AS (SELECT doc_id, regexp_matches(right(text, 300), 'ion') ::INT + regexp_matches(right(text, 300), '[0-9]') ::INT AS up, regexp_matches(right(text, 300), 'un') ::INT + regexp_matches(right(text, 300), '\bde\b') ::INT AS down FROM documents)
    SELECT doc_id, up, down, up >= down AS won FROM s
""")
def signal_counts(spark: SparkSession, d: str) -> DataFrame:
    """Which of two lists of patterns is met more often at the end of a text."""
    up, down = tx.hits("text", ["ion", "[0-9]"], 300), tx.hits("text", ["un", r"\bde\b"], 300)
    return docs_of(spark, d).select("doc_id", up.alias("up"), down.alias("down")).withColumn("won", F.col("up") >= F.col("down"))


@query(r"SELECT page_id, array_to_string(list_transform(string_split(replace(replace(regexp_extract(url, '([^/?#]*)/?(?:[?#].*)?$', 1), '-', ' '), '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS title FROM pages")
def slug_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.words_of_slug("url").alias("title"))


@query("""
    WITH w AS (SELECT conv_id, turn, text, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 6))) AS word FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY conv_id, turn) AS k FROM w)
    SELECT word, count(*) AS n, CAST(max(length(text)) AS INTEGER) AS longest, string_agg(substr(text, 1, 40), ' | ' ORDER BY k) FILTER (WHERE k <= 2) AS contexts FROM r GROUP BY word
""")
def mention_ranking(spark: SparkSession, d: str) -> DataFrame:
    """How often each long word is mentioned, the longest turn that does, and the first two contexts."""
    words = F.array_distinct(F.filter(tx.tokens("text"), lambda w: F.length(w) >= 6))
    each = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("length"), F.substring("text", 1, 40).alias("context"), F.explode(words).alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    first = ranking.top_per_group(each.select("word", "conv_id", "turn", "context"), "word", 2, F.col("conv_id"), F.col("turn"))
    contexts = first.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "context"))), lambda x: x["context"]), " | ").alias("contexts"))
    return counts.join(contexts, "word")


@query("""
    WITH w AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS t FROM documents)),
    c AS (SELECT word, count(*) AS n, min({'d': doc_id, 'p': pos}) AS first FROM w WHERE length(word) >= 8 GROUP BY word)
    SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS rank FROM c ORDER BY n DESC, first LIMIT 50
""")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent long words, of equally frequent ones the first seen."""
    each = docs_of(spark, d).select("doc_id", F.posexplode(tx.tokens("text")).alias("pos", "word")).filter(F.length("word") >= 8)
    counts = each.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")).orderBy(F.col("n").desc(), "first").limit(50)
    return counts.select("word", "n", F.row_number().over(Window.orderBy(F.col("n").desc(), "first")).alias("rank"))  # 50 rows


@query("SELECT source, array_to_string(list_sort(list(lang || '=' || n)), ' ') AS langs FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source")
def counters_by_source(spark: SparkSession, d: str) -> DataFrame:
    """A map of counts for each group."""
    counts = docs_of(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("of"))  # a map has an entry for each lang
    entries = F.transform(F.map_entries("of"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return counts.select("source", F.array_join(F.array_sort(entries), " ").alias("langs"))


@query("SELECT doc_id, round(list_sum(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: CAST(CASE WHEN length(x) <= 6 THEN x ELSE '0' END AS DOUBLE))), 2) AS total FROM documents WHERE len(regexp_extract_all(text, '[0-9]+')) > 0")
def amounts_total(spark: SparkSession, d: str) -> DataFrame:
    """The sum of all numbers of up to six digits in a text."""
    found = F.regexp_extract_all("text", F.lit("[0-9]+"), 0)
    total = F.aggregate(found, F.lit(0.0), lambda s, x: s + F.when(F.length(x) <= 6, x.cast("double")).otherwise(0.0))
    return docs_of(spark, d).filter(F.size(found) > 0).select("doc_id", F.round(total, 2).alias("total"))


@query(r"""
    SELECT doc_id FROM documents WHERE NOT (contains(lower(text), 'lorem') OR contains(lower(text), 'notice')) AND (len(regexp_extract_all(text, '\S+')) > 1 OR lower(trim(text)) IN ('yes', 'no'))
        AND (starts_with(source, 'src1') OR lang = 'de')
""")
def exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Rows without any of some phrases, without single words but allowed ones, of a source by its prefix or of a language."""
    low = F.lower("text")
    phrases = F.exists(F.array(F.lit("lorem"), F.lit("notice")), lambda p: F.contains(low, p))
    enough = (tx.word_count("text") > 1) | F.trim(low).isin("yes", "no")
    return docs_of(spark, d).filter(~phrases & enough & (F.col("source").startswith("src1") | (F.col("lang") == "de"))).select("doc_id")


RULES = [(1, "BRASS", "PROMO"), (2, "TIN", "SMALL"), (3, "XX", "STANDARD"), (4, "COPPER", "ECONOMY")]


@query(f"""
    WITH r(pos, code, name) AS (VALUES {', '.join(map(str, RULES))}), m AS (SELECT p_partkey, min({{'p': pos, 'n': CASE WHEN contains(p_type, code) THEN 0 ELSE 1 END}}) AS best FROM part JOIN r ON contains(p_type, code) OR contains(p_type, name) GROUP BY p_partkey)
    SELECT p.p_partkey AS p_partkey, coalesce(best.p, 0) AS pos, CASE best.n WHEN 0 THEN 'code' WHEN 1 THEN 'name' ELSE 'none' END AS by FROM part p LEFT JOIN m ON m.p_partkey = p.p_partkey
""")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    """The first of a table of rules that a row meets, by its code or else by its name; 0 and none where none is met. All codes and names are sought in one pass."""
    rules = spark.createDataFrame([(2 * pos + by, word) for pos, *words in RULES for by, word in enumerate(words)], "rule int, pattern string")  # two rows a rule
    rows = table(spark, d, "part").select("p_partkey", "p_type")
    first = patterns.find(rows, rules, "p_partkey", "rule", text="p_type").groupBy("p_partkey").agg(F.min("rule").alias("rule"))
    by = F.when(F.col("rule").isNull(), "none").when(F.col("rule") % 2 == 0, "code").otherwise("name")
    return rows.select("p_partkey").join(first, "p_partkey", "left").select("p_partkey", F.coalesce(F.floor(F.col("rule") / 2).cast("int"), F.lit(0)).alias("pos"), by.alias("by"))


@query("""
    SELECT doc_id, CAST(i AS INTEGER) AS pos, CASE i WHEN 0 THEN 'A < B & ' || source ELSE 'raw &amp; ' || lang END AS title, 'http://x/' || doc_id || '?a=1&b=' || i AS link FROM documents, (SELECT unnest([0, 1]) AS i) WHERE i = 1 OR source LIKE 'src%'
""")
def feed_reader(spark: SparkSession, d: str) -> DataFrame:
    """Items of feeds: one with entities, one with a quoted section; fields that are blank become null."""
    link = [F.concat(F.lit("<link>http://x/"), F.col("doc_id").cast("string"), F.lit(f"?a=1&amp;b={i}</link>")) for i in (0, 1)]
    one = F.concat(F.lit("<item><title>A &lt; B &amp; "), F.col("source"), F.lit("</title>"), link[0], F.lit("<description> </description></item>"))
    two = F.concat(F.lit('<item x="1">\n<title><![CDATA[raw &amp; '), F.col("lang"), F.lit("]]></title>"), link[1], F.lit("</item>"))
    feeds = docs_of(spark, d).select("doc_id", F.concat(F.lit("<rss><channel><title>t</title>"), one, two, F.lit("</channel></rss>")).alias("xml"))
    return feed_items(feeds).filter("summary IS NULL").select("doc_id", "pos", "title", "link")


@query("""
    SELECT doc_id, source AS title, array_to_string(list_filter([lang, 'R & D ' || source], lambda x: x <> ''), ', ') AS categories FROM documents WHERE contains(lower(source || chr(10) || lang || chr(10) || 'R & D ' || source), 'd src1') OR lang = 'fr'
""")
def feed_about(spark: SparkSession, d: str) -> DataFrame:
    """Items of feeds with their categories, those that are about one of a few words."""
    tags = [F.lit("<category>"), F.col("lang"), F.lit('</category><category domain="x"><![CDATA[R & D '), F.col("source"), F.lit("]]></category><category> </category>")]
    xml = F.concat(F.lit("<rss><item><title>"), F.col("source"), F.lit("</title>"), *tags, F.lit("</item></rss>"))
    items = feed_items(docs_of(spark, d).select("doc_id", xml.alias("xml")))
    return about(items, ["D src1", "FR"], "title", "categories").select("doc_id", "title", F.array_join("categories", ", ").alias("categories"))


@query("""
    WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 5 AND NOT list_contains(['and', 'or', 'not', 'near'], w)) AS w FROM documents),
    p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t), g AS (SELECT doc_id, x, min(i) AS i FROM p GROUP BY ALL), f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 12)
    SELECT doc_id, coalesce(asked, '') AS asked FROM documents LEFT JOIN (SELECT doc_id, string_agg(x, ' OR ' ORDER BY i) AS asked FROM f GROUP BY doc_id) USING (doc_id)
""")
def any_term_queries(spark: SparkSession, d: str) -> DataFrame:
    """A query for any of a document's first twelve longer terms."""
    return docs_of(spark, d).select("doc_id", tx.any_term("text", 5, 12).alias("asked"))


@query("""
    SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS number, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderstatus = 'F' THEN 'Clerk ' || o_custkey % 7 WHEN o_orderstatus = 'O' THEN 'desk ' || o_custkey % 5 END AS who FROM orders
""")
def labelled_fields(spark: SparkSession, d: str) -> DataFrame:
    """Number, day and signatory of a note, each by its patterns in turn."""
    who = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("\nSigned: Clerk "), (F.col("o_custkey") % 7).cast("string"))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("\nby the desk "), (F.col("o_custkey") % 5).cast("string"))).otherwise("\nSigned: ")
    note = F.concat(F.lit("ORDER No. "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.date_format("o_orderdate", "yyyy-MM-dd"), who, F.lit("\n"))
    fields = {"number": [r"(?i)order no\.? ?([0-9]+)"], "day": [r"dated ([0-9-]{10})", r"of ([0-9]{4}-[0-9]{2}-[0-9]{2})"], "who": [r"Signed: ([^\n]*)", r"by the (desk [0-9]+)"]}
    return table(spark, d, "orders").select("o_orderkey", tx.labelled(note, fields).alias("f")).select("o_orderkey", "f.*")


_FOUND = "list_concat(regexp_extract_all(text, '[0-9]{2,}'), regexp_extract_all(text, '[a-z]+ing'))"


@query(f"""
    WITH f AS (SELECT doc_id, list_filter({_FOUND}, lambda x: length(x) >= 3) AS n FROM documents)
    SELECT doc_id, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), ' ') AS found, upper(n[1]) AS first FROM f
""")
def references(spark: SparkSession, d: str) -> DataFrame:
    """All references of several forms in a text, and the first one in capitals."""
    found = tx.references("text", ["[0-9]{2,}", "[a-z]+ing"], 3)
    return docs_of(spark, d).select("doc_id", F.array_join(found, " ").alias("found"), F.upper(F.try_element_at(found, F.lit(1))).alias("first"))


@query("""
    WITH w AS (SELECT c_custkey, c_acctbal * (c_custkey % 1000) AS a, CAST(floor(abs(c_acctbal * (c_custkey % 1000))) AS BIGINT) AS u FROM customer)
    SELECT c_custkey, CASE WHEN a <= -1 THEN '-' ELSE '' END || CASE WHEN u >= 1000000 THEN (u // 1000000) || '.' || (u // 100000 % 10) || 'M' WHEN u >= 1000 THEN (u // 1000) || '.' || (u // 100 % 10) || 'K' ELSE CAST(u AS VARCHAR) END AS short FROM w
""")
def abbreviated_amounts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", tx.abbreviated(F.col("c_acctbal") * (F.col("c_custkey") % 1000)).alias("short"))


@query("SELECT s_suppkey, s_name AS party, s_name || ' v ' || n_name AS title FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def party_titles(spark: SparkSession, d: str) -> DataFrame:
    """Names as they stand in headings, cleaned, and a title of two of them."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    written = F.concat(F.lit(" Messrs.  "), F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, ", and Others. ").otherwise(" & others"))
    party = tx.plain_name(written)
    rows = table(spark, d, "supplier").join(F.broadcast(nations), "s_nationkey")  # 25 nations
    return rows.select("s_suppkey", party.alias("party"), F.concat_ws(" v ", party, "n_name").alias("title"))


@query("""
    SELECT d.doc_id AS doc_id, substr(coalesce(text, ''), 1, 120) || ' / ' || coalesce(lang, 'unknown') AS facts, CASE WHEN source IS NULL THEN 'none' ELSE 'from ' || source END AS origin,
           coalesce('quality ' || quality, 'not rated') AS holding FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
""")
def aspect_texts(spark: SparkSession, d: str) -> DataFrame:
    """Three texts of each document, of its beginning, its origin and its rating, with defaults for what is missing."""
    rated = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    facts = F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 120), F.lit(" / "), F.coalesce("lang", F.lit("unknown")))
    docs = docs_of(spark, d).select("doc_id", facts.alias("facts"), F.coalesce(F.concat(F.lit("from "), "source"), F.lit("none")).alias("origin"))
    return docs.join(rated, "doc_id", "left").withColumn("holding", F.coalesce(F.concat(F.lit("quality "), F.col("quality").cast("string")), F.lit("not rated"))).drop("quality")


@query("""
    WITH l AS (SELECT conv_id, turn, text, NOT ends_with(text, '.') AS open FROM conversations),
    r AS (SELECT *, sum(CASE WHEN open THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM l),
    f AS (SELECT *, open AND row_number() OVER (PARTITION BY conv_id, run, open ORDER BY turn) % 2 = 1 AS first FROM r),
    b AS (SELECT conv_id, turn, CASE WHEN first THEN text || coalesce(' ' || lead(text) OVER w, '') ELSE text END AS text, coalesce(lag(first) OVER w, false) AS taken FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, text FROM b WHERE NOT taken
""")
def continued_lines(spark: SparkSession, d: str) -> DataFrame:
    """Turns that don't end with a full stop take the next turn with them."""
    return relations.joined_lines(table(spark, d, "conversations"), "conv_id", "turn", "text", ~F.col("text").endswith("."))


@query("SELECT doc_id, 'http://x/' || doc_id || '?a: b' AS url, source || ' ' || lang AS title, CAST(CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS DATE) AS VARCHAR) AS date, length(text) AS chars FROM documents WHERE length(text) >= 500")
def headed_files(spark: SparkSession, d: str) -> DataFrame:
    """Texts with lines of fields at their head, parsed; those with a short body are left out."""
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).cast("string")
    head = F.concat(F.lit("URL: http://x/"), F.col("doc_id").cast("string"), F.lit("?a: b\nTITLE:  "), "source", F.lit(" "), "lang", F.lit(" \nDATE: "), date, F.lit("\n\n"), "text")
    parsed = docs_of(spark, d).select("doc_id", headed(head, "URL", "TITLE", "DATE").alias("p")).filter(F.length("p.body") >= 500)
    return parsed.select("doc_id", "p.url", "p.title", F.try_to_date("p.date").cast("string").alias("date"), F.length("p.body").cast("long").alias("chars"))


_PASSES, _VALUES = ["doc_id", "text AS t0"], []
for _i, (_kind, _pattern) in enumerate(tx.REDACTIONS):
    _PASSES.append(f"regexp_replace(t{_i}, '{_pattern}', '[{_kind.upper()}]', 'g') AS t{_i + 1}")
    _VALUES.append(f"SELECT '{_kind}' AS kind, doc_id, unnest(v) AS value, generate_subscripts(v, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(t{_i}, '{_pattern}') AS v FROM p)")


@query(f"""
    WITH p AS (SELECT {', '.join(_PASSES)} FROM documents), v AS ({' UNION ALL '.join(_VALUES)}), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id, pos) AS k FROM v)
    SELECT kind, count(*) AS n, string_agg(CASE WHEN length(value) <= 4 THEN repeat('*', length(value)) ELSE repeat('*', length(value) - 4) || right(value, 4) END, ' | ' ORDER BY k) FILTER (WHERE k <= 2) AS samples FROM r GROUP BY kind
""")
def redaction_report(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each kind are redacted, and the first two of them, masked."""
    each = written(docs_of(spark, d).select("doc_id", F.inline(tx.redacted_values("text"))), new_folder(spark, "values"))  # texts are searched once
    counts = each.groupBy("kind").agg(F.count("*").alias("n"))
    first = ranking.top_per_group(each, "kind", 2, F.col("doc_id"), F.col("pos")).select("kind", F.struct("rank", tx.masked("value").alias("value")).alias("s"))
    samples = first.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["value"]), " | ").alias("samples"))  # two at most
    return counts.join(samples, "kind")


@query("""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t, list_filter(regexp_split_to_array(lower(source || ' ' || lang || ' tion the'), '[^a-z0-9]+'), lambda x: x <> '') AS s FROM documents),
    p AS (SELECT doc_id, s, unnest(list_concat(s, t)) AS x, generate_subscripts(list_concat(s, t), 1) AS i FROM w), f AS (SELECT doc_id, x, min(i) AS i, bool_or(list_contains(s, x)) AS own FROM p GROUP BY ALL)
    SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS every, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT own), '') AS more FROM f GROUP BY doc_id
""")
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """The words of two lists, each once, in the order in which they come first, and those that only the second one has."""
    own, words = tx.tokens(F.concat_ws(" ", "source", "lang", F.lit("tion the"))), F.coalesce(tx.tokens("text"), F.array().cast("array<string>"))
    return docs_of(spark, d).select("doc_id", F.array_join(F.array_union(own, words), " ").alias("every"), F.array_join(F.array_except(words, own), " ").alias("more"))
