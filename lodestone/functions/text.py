"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_html(html: str | Column) -> Column:
    """Text of a page: scripts, styles and tags become spaces, white space collapses. Null stays null."""
    bare = F.regexp_replace(_col(html), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def tokens(text: str | Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.filter(F.split(F.lower(_col(text)), "[^a-z0-9]+"), lambda w: w != "")


def keywords(text: str | Column, least: int = 4, most: int = 8, stop: list[str] | None = None) -> Column:
    """The first ``most`` distinct words of at least ``least`` characters that are no stop words, in text order."""
    long = F.filter(tokens(text), lambda w: (F.length(w) >= least) & (~w.isin(stop) if stop else F.lit(True)))
    return F.slice(F.array_distinct(long), 1, most)


def any_term(text: str | Column, least: int, most: int, word: str = " OR ") -> Column:
    """A query for any of a text's terms: distinct, of at least ``least`` characters, the first ``most`` of them; words that steer a search are left out. Null and blank texts give an empty query."""
    terms = F.filter(tokens(text), lambda w: (F.length(w) >= least) & ~w.isin("and", "or", "not", "near"))
    return F.coalesce(F.array_join(F.slice(F.array_distinct(terms), 1, most), word), F.lit(""))


def labelled(text: str | Column, fields: dict[str, list[str]]) -> Column:
    """A struct of the named fields of a text: each the first group of its first pattern that finds one, trimmed; null where none does or it is blank."""
    found = lambda p: F.nullif(F.trim(F.regexp_extract(_col(text), p, 1)), F.lit(""))
    return F.struct(*[F.coalesce(*map(found, patterns)).alias(name) for name, patterns in fields.items()])


def first_year(text: str | Column, low: int = 1900, high: int = 2099) -> Column:
    """The first number of four digits between the bounds, null if there is none."""
    years = F.transform(F.regexp_extract_all(_col(text), F.lit(r"\b([0-9]{4})\b"), 1), lambda y: y.cast("int"))
    return F.try_element_at(F.filter(years, lambda y: (y >= low) & (y <= high)), F.lit(1))


def parse_list(value: str | Column) -> Column:
    """A list written as a JSON array of strings, or else with commas; null and blank give an empty list."""
    raw = F.trim(_col(value))
    parts = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    return F.coalesce(listed, F.when(raw != "", parts), F.array().cast("array<string>"))


def loose_json(reply: str | Column) -> Column:
    """The JSON object or array in a free-form reply, by whichever bracket comes first; null if it doesn't parse.

    It reaches to the first bracket up to which it parses: what follows, another object too, is left out.
    """
    raw = _col(reply)
    whole = F.regexp_extract(raw, r"(?s)(\{.*\}|\[.*\])", 1)

    def shorter(close: str) -> Column:
        parts = F.split(whole, "\\" + close)
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), close), F.lit(close)))
        return F.try_element_at(F.filter(every, lambda x: F.try_parse_json(x).isNotNull()), F.lit(1))

    first = F.when(whole.startswith("{"), shorter("}")).otherwise(shorter("]"))
    return F.when(whole != "", first)


def stable_key(*parts: str | Column) -> Column:
    """A key of 40 hexadecimal characters for trimmed, lower-cased parts, each written with its length, so that no two lists of parts are alike; a null part is a part of its own kind."""
    low = [F.trim(F.lower(_col(p))) for p in parts]
    return F.substring(F.sha2(F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in low]), 256), 1, 40)


#: What is redacted, in this order: later patterns see what earlier ones left.
REDACTIONS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b"),
    ("card", r"\b[0-9]{4}([ -]?[0-9]{4}){3}\b"),
    ("phone", r"\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}[ -]?[0-9]{3,4}\b"),
)


def redact(text: str | Column) -> Column:
    """Personal data replaced by its kind in brackets."""
    out = _col(text)
    for kind, pattern in REDACTIONS:
        out = F.regexp_replace(out, pattern, f"[{kind.upper()}]")
    return out


def redactions(text: str | Column) -> Column:
    """How many of each kind redact() replaces, as a struct."""
    left, counts = _col(text), []
    for kind, pattern in REDACTIONS:
        counts.append(F.regexp_count(left, F.lit(pattern)).alias(kind))
        left = F.regexp_replace(left, pattern, f"[{kind.upper()}]")
    return F.struct(*counts)


def clamp(value: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.least(_col(value), F.lit(high)), F.lit(low))


def ellipsis(text: str | Column, most: int) -> Column:
    """The text, or if it is longer than ``most`` characters, as much of it as fits with three dots behind."""
    t = _col(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def url_part(text: str | Column) -> Column:
    """Percent-encoded for any part of a URL: all but letters, digits and -_.~"""
    form = F.url_encode(_col(text))
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def word_count(text: str | Column) -> Column:
    """Runs without white space; null has none."""
    return F.coalesce(F.regexp_count(_col(text), F.lit(r"\S+")), F.lit(0))


def page_count(text: str | Column) -> Column:
    """Pages between form feeds: 1 and as many as there are form feeds."""
    return F.coalesce(F.regexp_count(_col(text), F.lit(r"\f")), F.lit(0)) + 1


def masked(secret: str | Column, shown: int = 4) -> Column:
    """Stars but for the last characters; a text of no more characters than these is all stars."""
    t = _col(secret)
    n = F.length(t)
    return F.when(n <= shown, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - shown), F.right(t, F.lit(shown))))


def plain_reply(reply: str | Column) -> Column:
    """A free-form reply without the fences around code and without white space around it."""
    return F.trim(F.regexp_replace(_col(reply), r"(?m)^```[A-Za-z]*[ ]*$", ""), F.lit(" \n"))


def words_of_slug(url: str | Column) -> Column:
    """The last part of a URL's path as words with capitals."""
    last = F.regexp_extract(_col(url), r"([^/?#]*)/?(?:[?#].*)?$", 1)
    return F.initcap(F.replace(F.replace(last, F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" ")))


def numbers(text: str | Column, pattern: str, low: int, high: int) -> Column:
    """The distinct whole numbers that a pattern's first group finds, those between the bounds, in text order."""
    found = F.transform(F.regexp_extract_all(_col(text), F.lit(pattern), 1), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda x: (x >= low) & (x <= high)))


def rule_labels(text: str | Column, rules: list[tuple[str, str]]) -> Column:
    """The labels of the (label, pattern) rules that match anywhere, in the rules' order, each once."""
    t = _col(text)
    return F.array_distinct(F.array_compact(F.array(*[F.when(t.rlike(pattern), F.lit(label)) for label, pattern in rules])))


def first_label(text: str | Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The label of the first rule of which any word is in the text, in any case; null counts as empty."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    return F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, F.lower(w))), F.lit(label)) for label, words in rules], F.lit(default))


def first_amount(text: str | Column, patterns: list[str], over: float) -> Column:
    """The first amount of the first pattern that finds one greater than ``over``; commas in it don't count."""

    def of(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(_col(text), F.lit(pattern), 1), lambda x: F.try_to_number(F.replace(x, F.lit(","), F.lit("")), F.lit("999999999999.99")).cast("double"))
        return F.try_element_at(F.filter(found, lambda x: x > over), F.lit(1))

    return F.coalesce(*map(of, patterns))


def paragraphs(text: str | Column, least: int) -> Column:
    """Parts between blank lines, trimmed, those longer than ``least`` characters."""
    return F.filter(F.transform(F.split(_col(text), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: F.length(p) > least)


def hits(text: str | Column, patterns: list[str], last: int) -> Column:
    """How many of the patterns match in the last characters of the text."""
    tail = F.right(F.coalesce(_col(text), F.lit("")), F.lit(last))
    return sum((tail.rlike(p).cast("int") for p in patterns), F.lit(0))


def references(text: str | Column, patterns: list[str], least: int) -> Column:
    """All that the patterns find, pattern by pattern, in text order, each once, those of at least ``least`` characters; null text has none."""
    t = F.coalesce(_col(text), F.lit(""))
    found = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), 0) for p in patterns]))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) >= least))


def abbreviated(amount: str | Column) -> Column:
    """An amount in millions or thousands, rounded towards zero to a tenth, or whole if it is less than a thousand."""
    a = _col(amount)
    whole = F.floor(F.abs(a)).cast("long")

    def tenths(unit: int, sign: str) -> Column:
        return F.concat(F.floor(whole / unit).cast("string"), F.lit("."), (F.floor(whole / (unit // 10)) % 10).cast("string"), F.lit(sign))

    size = F.when(whole >= 1_000_000, tenths(1_000_000, "M")).when(whole >= 1000, tenths(1000, "K")).otherwise(whole.cast("string"))
    return F.concat(F.when(a <= -1, "-").otherwise(""), size)


def plain_name(name: str | Column) -> Column:
    """A party's name without a form of address before it, without "and others" behind it, white space collapsed."""
    bare = F.regexp_replace(_col(name), r"(?i)^\s*((mr|mrs|ms|dr|messrs)\b\.?\s*)+", "")
    bare = F.regexp_replace(bare, r"(?i)[\s,]*(\band others\b|&\s*others\b)\s*\.?\s*$", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def redacted_values(text: str | Column) -> Column:
    """What redact() replaces, as an array of structs: kind, pos (from 0, within its kind) and value."""
    return _redacted(_col(text), REDACTIONS)


def _redacted(left: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The values of each rule; a text is searched once a rule, and replaced only where that found some."""
    kind, pattern = rules[0]
    found = F.coalesce(F.regexp_extract_all(left, F.lit(pattern), 0), F.array().cast("array<string>"))
    if kind == "email":
        found = F.when(F.contains(left, F.lit("@")), found).otherwise(F.array().cast("array<string>"))  # every match has one

    def of(step: Column) -> Column:
        """step: the text and what this rule found in it."""
        own = F.transform(step["found"], lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x.alias("value")))
        if len(rules) == 1:
            return own
        after = F.when(F.size(step["found"]) > 0, F.regexp_replace(step["left"], pattern, f"[{kind.upper()}]")).otherwise(step["left"])
        return F.concat(own, _redacted(after, rules[1:]))

    # a lambda over a list of one step holds its values, so that they are not computed again wherever they are named
    return F.flatten(F.transform(F.array(F.struct(left.alias("left"), found.alias("found"))), of))
