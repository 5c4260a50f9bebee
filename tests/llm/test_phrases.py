"""Phrase collocations against counting every phrase of every piece."""

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import phrases
from lodestone.llm.queries import ORACLE_SQL, QUERIES


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def brute(rows, least, depth, most, share):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            total[lang] += len(w)
            for k in range(1, depth + 1):
                f[lang].update(tuple(w[p : p + k]) for p in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + m] for p, b in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * b >= share * own[p[i : i + m]]}
        scored = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    words = ["der", "Die", "das", "é", "É", "x y", "a", "B", "0x1f\x1f", "日本", "\U0001f642"]
    out = []
    for k in range(150):
        text = "".join(rnd.choice(words) + rnd.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", " ; ", "\x0b"]) for _ in range(rnd.randrange(60)))
        out.append((text, rnd.choice(["de", "de", "fr", None, ""])))
    out += [(None, "de"), ("", None), (" \t . ,", "xx"), ("alone", "only"), ("same same " * 40, "fr"), ("new york city hall. " * 9 + "york city " * 2, "de")]
    return out + out[:40]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k % 50, t, x, "own", 3, 4.0) for k, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int, score double").repartition(4)


def got(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("least, share", [(1, 80), (3, 80), (8, 50), (3, 100)])
def test_against_all_phrases(docs, rows, least, share):
    want = brute(rows, least, 4, 2000, share)
    assert got(phrases.collocations(docs, least=least, share=share)) == want and len(want) > 20


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_full_sieve_and_small_shards(docs, rows, bits, monkeypatch):
    """A sieve that lets all or much through, and shards of a text or two, give the same rows; so does a short list."""
    monkeypatch.setattr(phrases, "SIEVE", bits)
    monkeypatch.setattr(phrases, "SHARD", 300)
    assert got(phrases.collocations(docs, least=3, most=7)) == brute(rows, 3, 4, 7, 80)
    assert got(phrases.collocations(docs, least=4, depth=2)) == brute(rows, 4, 2, 2000, 80)


def test_states_are_classes_of_ends():
    """Counts, and links that lead to the same phrase without its first word."""
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abc") for _ in range(30)) + ". " + rnd.choice("abc") for _ in range(20)]
    shard = phrases.Shard([t.encode() for t in texts], ["x"] * 20)
    every = [k != 0 for k in shard.keys(4)]
    seen = collections.Counter(tuple(w[p : p + k]) for t in texts for w in pieces_of(t) for k in range(1, 5) for p in range(len(w) - k + 1))
    found, last = {}, None
    for d, ends, count, link in shard.states(every):
        names = [tuple(x.split(" ")) for x in shard.phrases(ends, d).to_pylist()]
        assert len(names) == len(set(names))
        found |= dict(zip(names, count.tolist(), strict=True))
        if last:
            assert all(last[k] == p[1:] and found[last[k]] >= n for p, k, n in zip(names, link.tolist(), count.tolist(), strict=True))
        last = names
    assert found == dict(seen)


def test_exact_beyond_64_bits(spark, monkeypatch):
    """Counts whose products pass 64 bits."""
    big = 3_000_000_000_000_000_017
    counts = [("l", 0, "", 2 * big), ("l", 1, "a", big), ("l", 1, "b", big - 9), ("l", 2, "a b", big - 20), ("l", 1, "c", big), ("l", 2, "b c", 7), ("l", 3, "a b c", (big - 20) // 5 * 4 - 1)]
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: spark.createDataFrame(counts, "lang string, words int, phrase string, n long"))
    a, abc = big - 20, (big - 20) // 5 * 4 - 1
    want = [(a, 2_000_000 * a // (2 * big - 9), "a b", big, big - 9), (7, 2_000_000 * 7 // (2 * big - 9), "b c", big - 9, big), (abc, min(2_000_000 * abc // (big + 7), 2_000_000 * abc // (a + big)), "a b c", a, big)]
    rows = {r.phrase: (r.a, r.score, r.phrase, r.l, r.r) for r in phrases.collocations(spark.range(0)).collect()}
    inside = {p for p, n in (("a b", a), ("b c", 7)) if 100 * abc >= 80 * n}
    assert inside == {"b c"} and rows == {w[2]: w for w in want if w[2] not in inside}


def test_one_long_text(spark):
    rnd = random.Random(4)
    text = " ".join(rnd.choice(["ja", "no", "si"]) + ("," if rnd.random() < 0.05 else "") for _ in range(300_000))
    frame = spark.createDataFrame([(1, text, "q"), (2, "ja no", "q")], "doc_id long, text string, lang string")
    assert got(phrases.collocations(frame)) == brute([(text, "q"), ("ja no", "q")], 30, 4, 2000, 80)


def test_query_and_sql(spark, rows, tmp_path):
    spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(rows * 3)], "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ours = got(QUERIES["op12_phrase_collocations"](spark, str(tmp_path)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    assert ours == brute(rows * 3, 30, 4, 2000, 80) == sorted(con.sql(ORACLE_SQL["op12_phrase_collocations"]).fetchall()) and len(ours) > 50


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert phrases.Shard([], []).words.to_pylist() == [] and pa.array([]).to_pylist() == []
