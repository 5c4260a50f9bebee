"""Spelling variants against comparing every two words, over odd tables, crowded keys and colliding ones."""

import collections
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import spelling
from lodestone.llm.queries import ORACLE_SQL, QUERIES

UPPER = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(counts, ratio=5):
    out, form = {}, {}
    for w, n in counts.items():
        close = [(-m, v) for v, m in counts.items() if near(w, v)]
        best = min(close, default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n else None
        out[w] = (n, len(close), -best[0] if form[w] else None)
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


def by_word(frame):
    rows = frame.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_one_edit():
    assert spelling.one_edit("abc", "abd") and spelling.one_edit("abc", "abcd") and spelling.one_edit("aab", "aaab") and spelling.one_edit("bc", "abc")
    assert not spelling.one_edit("abc", "abc") and not spelling.one_edit("abc", "acb") and not spelling.one_edit("abc", "abcde") and not spelling.one_edit("abcd", "abc") and not spelling.one_edit("ab", "bcd")


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "etaoinshrdluÀÿ"])
def test_variants(spark, letters):
    """Few letters make crowded keys, repeated grams and shifts by one; many make rare ones."""
    rnd = random.Random(len(letters))
    counts = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(6, 12))): rnd.randrange(5, 60) for _ in range(350)}
    for w in [*counts][:120]:
        k, n = rnd.randrange(len(w)), rnd.choice([5, 7, 5 * counts[w], 5 * counts[w] - 1, 25 * counts[w], 130 * counts[w]])
        for v in (w[:k] + w[k + 1 :], w[:k] + rnd.choice(letters) + w[k:], w[:k] + rnd.choice(letters) + w[k + 1 :]):
            if len(v) >= 6 and rnd.random() < 0.6:
                counts.setdefault(v, n)
    words = spark.createDataFrame([(w, n, "own") for w, n in counts.items()], "word string, n long, key string")
    got = by_word(spelling.variants(words.repartition(5)))
    assert got == plain(counts) and any(v[0] for v in got.values())


def test_long_chain_and_long_words(spark):
    chain = {"abcdefgh"[:k] + "zzzzzzz"[: 8 - k]: 5 ** (k + 1) for k in range(8)}  # each form five times as common as the word before
    long = "".join(random.Random(1).choice("abcd") for _ in range(30_000))
    counts = chain | {long: 100, long[:777] + long[778:]: 10, "x" * 500: 9, "x" * 501: 45, "x" * 499 + "y": 5}
    got = by_word(spelling.variants(spark.createDataFrame([*counts.items()], "word string, n long")))
    assert got == plain(counts) and {got[w][1] for w in chain} == {"abcdefgz"}


def test_keys_that_collide(spark, monkeypatch):
    """All words under few keys, of unlike lengths too: more to compare, the same pairs."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.length(c[2]) % 2 + F.lit(0).cast("long"))
    rnd = random.Random(6)
    counts = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(6, 11))): 5 + k for k in range(60)}
    assert by_word(spelling.variants(spark.createDataFrame([*counts.items()], "word string, n long"))) == plain(counts)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(23)
    stems = ["".join(rnd.choice(["ka", "to", "MI", "ré", "su", "Ne", "lo", "Ü", "ß"]) for _ in range(rnd.randrange(3, 6))) for _ in range(25)]
    out = [" ".join(rnd.choice(stems) for _ in range(rnd.randrange(1, 300))) for _ in range(60)]
    out += [None, "", " \n", "7 ½ ×÷ ×××××××", "short words in it", stems[0] * 40_000, "x'" + stems[1] + "-" + stems[1] + "_" + stems[2] + "9" + stems[3], "日本" + stems[4] + "日", " ".join(stems) * 3]
    return [(None if k == 5 else k % 50, t) for k, t in enumerate(out)]


def test_query(spark, texts, tmp_path):
    counts = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(UPPER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    frame = spark.createDataFrame([(i, t, "own", 1, 2) for i, t in texts], "doc_id long, text string, word string, n int, p int")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert by_word(QUERIES["op11_spelling_variants"](spark, str(tmp_path))) == plain(counts) and len(counts) > 20
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE strlen(text) < 100000")
    small = spark.read.parquet(f"{tmp_path}/documents.parquet").filter("text is null or octet_length(text) < 100000")
    assert by_word(spelling.spelling_variants(small)) == {r[0]: r[1:] for r in con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({ORACLE_SQL['op11_spelling_variants']})").fetchall()}


def test_no_words(spark):
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), least=5)
