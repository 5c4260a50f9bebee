"""Readers: tables with their expected columns, whole text files, HTML pages and feed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``; filters and columns are pushed into its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_files(spark: SparkSession, path: str, least_chars: int = 0, limit: int | None = None) -> DataFrame:
    """Whole text files: path, text. Shorter ones than ``least_chars`` are left out; with a limit, those first by path stay."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    files = files.filter(F.length("text") >= least_chars)
    return files if limit is None else files.orderBy("path").limit(limit)


def header_field(text: str | Column, name: str) -> Column:
    """Value of a ``NAME: value`` line at the head of a text, null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(text if isinstance(text, Column) else F.col(text), rf"(?im)^{name}:[ \t]*(.*)$", 1)), F.lit(""))


def unescaped(xml: Column) -> Column:
    """Text of an XML value: the five named entities, the ampersand last."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        xml = F.replace(xml, F.lit(f"&{name};"), F.lit(sign))
    return xml


def feed_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """The items of RSS feeds: the feed's other columns, pos (from 0), title, link, published, summary, categories.

    Null and empty fields of an item become null, categories are a list without blanks; a feed without items has no row.
    """

    def value(tag: Column, name: str) -> Column:
        raw = F.regexp_extract(tag, rf"(?s)<{name}(?:\s[^>]*)?>(<!\[CDATA\[)?(.*?)(?:\]\]>)?</{name}>", 2)
        quoted = tag.rlike(rf"<{name}(?:\s[^>]*)?><!\[CDATA\[")
        return F.nullif(F.trim(F.when(quoted, raw).otherwise(unescaped(raw))), F.lit(""))

    def field(name: str) -> Column:
        return value(F.col("item"), name)

    every = F.regexp_extract_all(F.col("item"), F.lit(r"(?s)<category(?:\s[^>]*)?>.*?</category>"), 0)
    others = [c for c in feeds.columns if c != xml]
    items = feeds.select(*others, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<item[\s>].*?</item>"), 0)).alias("pos", "item"))
    named = [field(tag).alias(name) for tag, name in (("title", "title"), ("link", "link"), ("pubDate", "published"), ("description", "summary"))]
    return items.select(*others, "pos", *named, F.array_compact(F.transform(every, lambda x: value(x, "category"))).alias("categories"))


def about(items: DataFrame, words: list[str], *columns: str) -> DataFrame:
    """Rows of which one of the columns (text, or a list of texts) holds one of the words, in upper or lower case; all rows if there are no words."""
    if not words:
        return items
    kinds = dict(items.dtypes)
    whole = F.lower(F.concat_ws("\n", *[F.array_join(c, "\n") if kinds[c].startswith("array") else F.col(c) for c in columns]))
    found = F.lit(False)
    for w in words:
        found = found | whole.contains(w.lower())
    return items.filter(found)


def headed(text: str | Column, *names: str) -> Column:
    """A text that begins with ``NAME: value`` lines up to a blank one, as a struct: each name in lower case, and body, what follows the blank line (all of it if there are no such lines)."""
    whole = text if isinstance(text, Column) else F.col(text)
    head = F.regexp_extract(whole, r"(?s)^((?:[A-Za-z]+:[^\n]*\n)+)\n", 1)
    body = F.when(head != "", F.substring(whole, F.length(head) + 2, F.length(whole))).otherwise(whole)
    return F.struct(*[header_field(head, name).alias(name.lower()) for name in names], body.alias("body"))
