"""Every opN_ query over a small table, each column of its contract against brute force; nulls, blanks, copies, clashing columns and a text above 10 MB are in it."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.queries import ORACLE_SQL, QUERIES

from .test_llm import best_fit_decreasing, brute_classes, plain_loads, sentence


def crc(i):
    return zlib.crc32(str(i).encode() if i is not None else b"")


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(17)
    base = [sentence(rnd, rnd.randrange(5, 160)) for _ in range(40)]
    passage = sentence(rnd, 25)
    out = [*base, base[3], base[4].upper(), None, None, "", " \t\n", "7 7", "é" * 300, "AÉa"]
    out += [base[k] + "\n" + passage + " " + base[k + 1] for k in range(6, 12)]
    out += [base[5] + " more", sentence(rnd, 3000)]
    block = sentence(rnd, 4000) + " "
    out.append(block * (10_500_000 // len(block.encode()) + 1))
    ids = rnd.sample(range(1, 1000), len(out))
    return [*zip(ids, out, strict=True), (None, passage + " of nobody")]


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, None if k % 5 == 0 else "aa" if k % 2 else "bb", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("held_out", "shard", "row", "size", "label", "sketch", "bucket"):
        frame = frame.withColumn(name, F.lit("own"))
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    vectors = [(i, [math.sin(i * k + k) * (1 + i % 9) for k in range(1, 6)]) for i in range(200)]
    vectors += [(200, None), (220, [1.0, None, 0.0, 0.0, 0.0]), (240, [float("nan")] * 5), (260, [float("inf")] + [0.0] * 4), (280, [1.0, 2.0]), (300, [0.5, 2.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("norm", F.lit("own")).repartition(2).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def codec():
    out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out.no_truncation()
    out.no_padding()
    return out


@pytest.fixture(scope="module")
def ids(texts, codec):
    return {i: codec.encode(t or "", add_special_tokens=False).ids for i, t in texts}


def rows_of(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


def by_id(spark, folder, name, texts):
    rows = rows_of(spark, folder, name)
    assert len(rows) == len(texts)
    out = {r.doc_id: r for r in rows}
    assert set(out) == {i for i, _ in texts}
    return out


def test_op1(spark, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(ORACLE_SQL["op1_exact_top_k"]).fetchall())
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows_of(spark, folder, "op1_exact_top_k"))
    assert got == sorted((q, k, v, s) for q, k, v, s in want) and {q for q, *_ in got} == {*range(0, 200, 20), 280, 300}


def test_op2(spark, folder, ids):
    many = collections.Counter(map(len, ids.values()))
    rows = rows_of(spark, folder, "op2_token_counts")
    assert {r.length: r.n_docs for r in rows} == many
    for r in rows:
        longer = [n for x, n in many.items() if x > r.length]
        assert (r.docs_longer, r.docs_upto, r.n_all) == (sum(longer), len(ids) - sum(longer), len(ids))
        assert (r.total_tokens, r.tokens_longer) == (sum(map(len, ids.values())), sum(x * n for x, n in many.items() if x > r.length))
        assert r.truncated_tokens == sum(min(x, r.length) * n for x, n in many.items())


def test_op3(spark, folder, texts):
    got = by_id(spark, folder, "op3_language_id", texts)
    for i, t in texts:
        r = got[i]
        assert r.held_out == (crc(i) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", t or "")) and r.lang_pred in ("aa", "bb", "und")


def test_op4(spark, folder, texts):
    got = collections.defaultdict(set)
    for i, r in by_id(spark, folder, "op4_minhash_near_dedup", texts).items():
        got[r.class_id].add(i)
        assert r.kept == (r.class_id == i)
    assert {frozenset(x) for x in got.values()} == brute_classes(texts)


def test_op5(spark, folder, texts):
    got = by_id(spark, folder, "op5_sharding", texts)
    weight, places, slots, load = collections.Counter(), collections.defaultdict(set), collections.defaultdict(list), collections.Counter()
    for i, t in texts:
        r, raw = got[i], (t or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 40
        weight[raw] += r["size"]
        places[raw].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(len(x) == 1 for x in places.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sorted(load[k] for k in range(40)) == sorted(plain_loads(weight.values(), 40))


def test_op6(spark, folder, ids):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows_of(spark, folder, "op6_best_fit_packing"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r["length"]))
    assert set(pieces) == set(ids)
    lengths = collections.Counter()
    for i, own in ids.items():
        own = [*own, 0]
        cut = [own[k : k + 2048] for k in range(0, len(own), 2048)]
        rows = sorted(pieces[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r["length"], r.ids_crc32) for r in rows] == [(k, 2048 * k, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for k, x in enumerate(cut)]
        lengths.update(map(len, cut))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(sequences) <= best_fit_decreasing(lengths, 2048)


def test_op7(spark, folder, texts, ids, codec):
    for i, r in by_id(spark, folder, "op7_bpe_codec", texts).items():
        own = ids[i]
        assert r.n_tokens == len(own) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(codec.decode(own, skip_special_tokens=False).encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_op8(spark, folder, texts):
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[lower(t)].append(i)
    got = by_id(spark, folder, "op8_exact_dedup", texts)
    for i, t in texts:
        own, r = groups[lower(t)], got[i]
        best = max(own, key=lambda x: -1 if x is None else x)
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best, len(own), i == best, hashlib.sha256(lower(t).encode()).hexdigest())


def test_op9(spark, folder, texts):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for i, t in texts}
    out = {i for i in words if crc(i) % 7 == 2}
    seen = collections.Counter(w for i, own in words.items() if i not in out for w in own)
    ends = len(words) - len(out)
    n, v = sum(seen.values()) + ends, len(seen) + 1
    got = by_id(spark, folder, "op9_lm_scoring", texts)
    for i, own in words.items():
        r, many = got[i], collections.Counter(own)
        base = sum(k * math.log10((seen[w] + 1) / (n + v + 1)) for w, k in many.items()) + math.log10((ends + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in out, len(own) + 1, sum(w in seen for w in own) + 1, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_op10(spark, folder, texts):
    got = by_id(spark, folder, "op10_suffix_array_dedup", texts)
    seen: set[bytes] = set()
    for i, t in sorted(((i, t) for i, t in texts if i is not None), key=lambda x: x[0]):
        raw = (t or "").encode()
        starts = [k for k in range(len(raw) - 49) if raw[k : k + 50] in seen] if seen else []
        spans: list[list[int]] = []
        for k in starts:
            if spans and k <= spans[-1][1]:
                spans[-1][1] = k + 50
            else:
                spans.append([k, k + 50])
        kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)], strict=True))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
        seen.update(raw[k : k + 50] for k in range(len(raw) - 49))
    nobody = texts[-1][1].encode()
    assert (got[None].n_bytes, got[None].n_removed) == (len(nobody), 0)


def test_empty_tables(spark, tmp_path):
    """No rows in, no rows out, for every query, with the columns it has otherwise."""
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
