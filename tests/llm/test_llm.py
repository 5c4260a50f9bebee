"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bpe, counts, dedup, language, lattice, neardup, packing, sharding, suffixes, topk

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Names that operators use themselves, as extra columns of the input.
CLASHING = ("row", "chunk", "shard", "bucket", "sha", "number", "rank", "length", "sub", "at", "sig", "centre", "own", "rest")


def word(rnd):
    return "".join(rnd.choice(["ka", "to", "mi", "ré", "su", "ne", "lo", "Da", "x"]) for _ in range(rnd.randrange(1, 5)))


def sentence(rnd, n):
    return " ".join(word(rnd) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    base = [sentence(rnd, rnd.randrange(1, 120)) for _ in range(30)]
    passage = sentence(rnd, 25)
    out = [*base, *base[:6], base[0].upper(), None, "", None, " \n\t ", "x", "é" * 40, "ab" * 300, "ab" * 260, sentence(rnd, 9000)]
    out += [base[k] + " " + passage + " " + base[k + 1] for k in range(6, 14)]
    out += [t.replace(t.split()[5], "changed", 1) for t in base if len(t.split()) > 60][:5]
    return list(enumerate(out, start=10))


@pytest.fixture(scope="module")
def docs(spark, texts):
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for name in CLASHING:
        frame = frame.withColumn(name, F.lit("own").cast("string"))
    return frame.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids."""
    rows = [(None, "some words that are here twice and are long enough for all of the operators to see"), (None, None), (4, "a b"), (4, "a b"), (4, "c d"), (5, "A B")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def by_id(frame):
    rows = frame.collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


# top-k


def brute_top(vectors, queries, k):
    out = {}
    for q, x in queries:
        scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v) for v, y in vectors if v != q and len(y) == len(x))
        out[q] = [(v, -s) for s, v in scores[:k]]
    return out


@pytest.mark.parametrize("dim", [1, 6])
def test_top_k(spark, dim, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS", 50)
    monkeypatch.setattr(topk, "SEEDS", 40)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rnd = random.Random(dim)
    vectors = [(i, [int(rnd.gauss(0, 20) * (1 + (i % 7 == 0) * 5)) for _ in range(dim)]) for i in range(400)]
    vectors += [(i, vectors[3][1]) for i in range(400, 460)] + [(i, [0] * dim) for i in range(460, 470)] + [(500, [1] * (dim + 1))]
    rows = spark.createDataFrame([*vectors, (None, [1] * dim), (600, None), (601, [None] * dim)], "vec_id long, vector array<long>").withColumn("norm", F.lit("own"))
    asked = [v for v in vectors if v[0] % 10 == 0]
    got = collections.defaultdict(list)
    for r in topk.top_k(rows, rows.filter("vec_id % 10 = 0"), 7).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_top(vectors, asked, 7)
    assert {q: v for q, v in want.items() if v} == got


def test_top_k_few_and_none(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "vec_id long, vector array<long>")
    assert topk.top_k(rows, rows, 20).count() == 2
    assert topk.top_k(rows.limit(0), rows, 20).count() == 0
    assert topk.top_k(rows, rows.limit(0), 20).count() == 0


def test_coordinate_pruning_keeps_all_that_reach_the_threshold():
    rnd = np.random.default_rng(1)
    block = topk.Block(np.arange(300), rnd.integers(-50, 50, (300, 5)))
    pruned = 0
    for _ in range(200):
        q = rnd.integers(-50, 50, 5)
        scores = block.matrix @ q
        least = float(np.sort(scores)[-10])
        places = block.candidates(q, float(np.sqrt((q**2).sum())), least)
        assert set(np.flatnonzero(scores >= least)) <= set(np.arange(300)[places])
        pruned += 300 - len(block.ids[places])
    assert pruned > 1000


# tokens


def test_bpe_equals_the_library():
    tool, ours = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    rnd = random.Random(2)
    pool = [*"aaabbbsdtré  \t\n'ÉİΣσÅ\x1c\x1f\x85 123!?.,", "'ll", "'RE", "n't", "<|endoftext|>", "<|startoftext|>", "가", "ﬁ", "é", "漢字", "🙂", "the", "tion"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(50))) for _ in range(800)] + ["", "a" * 3000, "aaa aaaa aaaaa", "ΑΣ ΑΣ", "é" * 500]
    for text, coded in zip(texts, ours.encode(texts), strict=True):
        ids = np.frombuffer(coded, "<u4")
        want = tool.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text)
        assert ours.decode(ids) == tool.decode(want, skip_special_tokens=False)


def test_bpe_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    ours, tool = bpe.Codec(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(3)
    for n in (5, 30, 60, 10, 25):
        texts = [sentence(rnd, n) for _ in range(3)]
        assert [np.frombuffer(c, "<u4").tolist() for c in ours.encode(texts)] == [tool.encode(t, add_special_tokens=False).ids for t in texts]


def test_encode_decode(docs, texts, empty, odd):
    tool = Tokenizer.from_file(PATH)
    got = by_id(bpe.encode_decode(docs, PATH))
    assert len(got) == len(texts)
    for i, t in texts:
        ids = tool.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == tool.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty, PATH).count() == 0
    assert bpe.encode_decode(odd, PATH).count() == 6


def test_token_counts(docs, texts, empty):
    tool = Tokenizer.from_file(PATH)
    sizes = np.array([len(tool.encode(t or "", add_special_tokens=False).ids) for _, t in texts])
    rows = counts.token_counts(docs, PATH).collect()
    assert {r.length: r.n_docs for r in rows} == collections.Counter(sizes.tolist())
    for r in rows:
        assert (r.total_tokens, r.n_all) == (sizes.sum(), len(sizes))
        assert r.truncated_tokens == np.minimum(sizes, r.length).sum()
        assert (r.docs_longer, r.docs_upto, r.tokens_longer) == ((sizes > r.length).sum(), (sizes <= r.length).sum(), sizes[sizes > r.length].sum())
    assert counts.token_counts(empty, PATH).count() == 0


# language


def test_language_held_out_and_mixtures(spark, small, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.train(docs.filter(~odd))
    rows = language.identify(docs.filter(odd), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    fr, en = (docs.filter(f"lang = '{x}' and n_chars > 1500").orderBy("doc_id").first().text[:1500] for x in ("fr", "en"))
    mixed = spark.createDataFrame([(1, fr + " " + en[:500]), (2, en), (3, None), (4, "12 + 3 !"), (5, ""), (6, "x"), (7, en * 40)], "doc_id long, text string").withColumn("lang_pred", F.lit("own")).withColumn("p", F.lit(1))
    got = by_id(language.identify(mixed, model))
    assert got[1].lang_pred == "fr" and 0.55 < got[1].score < 0.95
    assert got[2].lang_pred == got[7].lang_pred == "en" and got[2].score == got[7].score == 1
    assert [(got[k].lang_pred, got[k].score) for k in (3, 4, 5)] == [("und", 0.0)] * 3
    assert got[6].lang_pred in model.languages
    assert language.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language.identify(mixed, language.train(empty)).collect()} == {"und"}


def test_mixture_em_finds_the_proportions():
    rnd = np.random.default_rng(0)
    p = rnd.dirichlet(np.full(language.FEATURES, 0.05), 3).astype(np.float32) + 1e-7
    p /= p.sum(1, keepdims=True)
    model = language.Model(["a", "b", "c"], p, np.full(3, 1 / 3))
    counts_ = np.stack([rnd.multinomial(4000, q / q.sum()) for q in (p[0].astype(float), (0.7 * p[1] + 0.3 * p[2]).astype(float))]).astype(np.float32)
    top, share = model.infer(counts_)
    assert top.tolist() == [0, 1] and share[0] == 1 and abs(share[1] - 0.7) < 0.05


# exact dedup


@pytest.mark.parametrize("block", [16, 1024])
def test_exact_duplicates(docs, texts, empty, odd, block, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", block)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[(t or "").translate(low)].append(i)
    got = by_id(dedup.exact_duplicates(docs))
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.digest) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert len(got) == len(texts)
    assert dedup.exact_duplicates(empty).count() == 0
    rows = dedup.exact_duplicates(odd).collect()
    assert len(rows) == 6 and sum(r.kept for r in rows) == 4
    kept = dedup.deduplicate(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {max(ids) for ids in groups.values()}
    assert dedup.deduplicate(odd).count() == 4


def test_local_items_start_anew_when_full(monkeypatch):
    monkeypatch.setattr(dedup, "REMEMBERED", 10)
    local = dedup.Local()
    for pos, item in enumerate([b"aaaa", b"aaaa", b"bbbb", b"aaaa"]):
        local.add(1, pos, item, None, None)
    assert local.take().column("of_pos").to_pylist() == [0, 0, 2, 3]


# near dedup


def brute_classes(texts, least=0.8):
    parent = {i: i for i, _ in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shingles = {}
    for i, t in texts:
        w = (t or "").lower().split()
        seen = collections.Counter()
        own = []
        for k in range(max(1, len(w) - 4) if w else 0):
            s = tuple(w[k : k + 5])
            own.append((s, seen[s]))
            seen[s] += 1
        shingles[i] = own
    ids = [i for i, _ in texts]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = shingles[a], shingles[b]
            common = len(set(x) & set(y))
            if x and y and common / (len(x) + len(y) - common) >= least:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    out = collections.defaultdict(set)
    for i in ids:
        out[root(i)].add(i)
    return {frozenset(x) for x in out.values()}


def test_near_duplicates(docs, texts, empty, odd):
    rows = neardup.near_duplicates(docs).collect()
    got = collections.defaultdict(set)
    for r in rows:
        got[r.class_id].add(r.doc_id)
        assert r.kept == (r.doc_id == r.class_id)
    assert {r.doc_id: r.class_size for r in rows} == {i: len(got[r.class_id]) for r in rows for i in [r.doc_id]}
    assert {frozenset(x) for x in got.values()} == brute_classes(texts)
    assert neardup.near_duplicates(empty).count() == 0
    assert sorted((r.class_size, r.kept) for r in neardup.near_duplicates(odd).collect()) == [(1, True)] * 3 + [(3, False)] * 2 + [(3, True)]
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(got)


@pytest.mark.parametrize("block", [4, 1024])
def test_near_duplicates_of_one_large_group(spark, block, monkeypatch):
    """Many different copies of one text make one class, in one block and in several; other texts stay out."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rnd = random.Random(9)
    base = sentence(rnd, 300).split()
    texts = []
    for i in range(150):
        own = list(base)
        for k in rnd.sample(range(300), 2):
            own[k] = f"w{i}"
        texts.append((i, " ".join(own)))
    texts += [(i, sentence(rnd, 200)) for i in range(150, 170)]
    got = collections.Counter(r.class_id for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got[0] == 150 and len(got) == 21


def changed(rnd, words, edits):
    """``words`` with so many of them replaced by new ones."""
    own = list(words)
    for k in rnd.sample(range(len(own)), edits):
        own[k] = f"w{rnd.random()}"
    return own


def classes_of(spark, texts):
    got = collections.defaultdict(set)
    for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got[r.class_id].add(r.doc_id)
    return {frozenset(x) for x in got.values()}


def test_near_duplicates_of_chains_in_large_buckets(spark, monkeypatch):
    """Copies of copies: most are like the one that they were made of and one or two more, and unlike the rest of their buckets."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rnd = random.Random(3)
    own = [sentence(rnd, 120).split()]
    for _ in range(150):
        own.append(changed(rnd, rnd.choice(own), 2 if rnd.random() < 0.8 else 3))
    rnd.shuffle(own)
    texts = [(i, " ".join(w)) for i, w in enumerate(own)]
    want = brute_classes(texts)
    assert 1 < len(want) < 100 and classes_of(spark, texts) == want


def test_near_duplicates_of_a_star_of_thousands(spark):
    """Copies like the original alone: about 0.82 like it, 0.67 like each other."""
    rnd = random.Random(8)
    base = sentence(rnd, 105).split()
    texts = [(i, changed(rnd, base, 2)) for i in range(3000)]
    texts.insert(1500, (3000, base))
    own = {i: neardup.labelled([w])[0] for i, w in texts}
    like = {i for i, label in own.items() if neardup.similarity(label, own[3000], 0.8) > 0}
    got = classes_of(spark, [(i, " ".join(w)) for i, w in texts])
    assert len(like) > 2900 and like in got


@pytest.mark.parametrize("block", [8, 1024])
def test_triples_in_large_buckets(spark, block, monkeypatch):
    """y is like c and x, which are not like each other, twelve times in buckets that they share with hundreds of texts unlike all of them."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rnd = random.Random(6)
    base = sentence(rnd, 105).split()
    texts = [changed(rnd, base, 4) for _ in range(300)]
    for _ in range(12):
        c = changed(rnd, base, 3)
        texts += [c, y := changed(rnd, c, 1), changed(rnd, y, 1)]
    rnd.shuffle(texts)
    texts = [(i, " ".join(w)) for i, w in enumerate(texts)]
    want = brute_classes(texts)
    assert len(want) > 100 and sum(len(x) > 2 for x in want) >= 9
    assert classes_of(spark, texts) == want


def test_near_duplicate_recall(spark):
    """Over 1,200 documents of all lengths, copies of copies among them, the classes are those of all pairs compared."""
    rnd = random.Random(21)
    texts = []
    while len(texts) < 1200:
        texts.append(sentence(rnd, rnd.choice([6, 12, 30, 80, 200, 500])).split())
        for _ in range(rnd.choice([0, 0, 1, 3])):
            own = texts[-1]
            texts.append(changed(rnd, own, min(len(own), max(1, round(len(own) * rnd.choice([0.004, 0.01, 0.018, 0.024]))))))
    texts = [(i, " ".join(w)) for i, w in enumerate(texts)]
    assert classes_of(spark, texts) == brute_classes(texts)


def test_possible_loses_no_pair():
    """Of all pairs of blocks, none that is alike is ruled out by sizes or parities, and hardly any that is not."""
    rnd = random.Random(2)
    base = sentence(rnd, 300).split()
    words = [changed(rnd, base, rnd.randrange(14)) for _ in range(60)] + [sentence(rnd, 280).split() for _ in range(20)]
    label, size = neardup.labelled(words)
    own = np.split(label, np.cumsum(size)[:-1])
    parity = neardup.parities(label, size).view(np.uint64)
    first, met, probes = np.array([0, 30, 31]), np.array([20, 0, 29]), np.array([10, 1, 20])
    ids = np.arange(80)
    a, b = neardup.possible(first, met, probes, size, np.where(ids == 7, 3, ids), parity, 0.8)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    pairs = [(x, y) for f, m, p in zip(first, met, probes, strict=True) for x in range(f, f + m) for y in range(f + m, f + m + p)]
    alike = {(x, y) for x, y in pairs if neardup.similarity(own[x], own[y], 0.8) > 0}
    assert alike and alike <= found and len(found) < 1.5 * len(alike) and found <= set(pairs)


@pytest.mark.parametrize("block", [4, 1024])
def test_near_duplicates_of_short_texts(spark, block, monkeypatch):
    """Pairs that share no sketch at all, 8 words against 9, or hardly any, 9 against 10; and groups of these with one common word more."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rnd = random.Random(12)
    texts = []
    for n in (1, 3, 5, 7, 8, 9, 10, 12, 14, 18, 24):
        for _ in range(25):
            own = [f"{word(rnd)}{rnd.random()}" for _ in range(n)]
            texts += [own, [*own, "more"], ["less", *own], changed(rnd, own, 1)][: rnd.randrange(2, 5)]
    own = sentence(rnd, 9).split()
    texts += [[*own, f"end{i}"] for i in range(40)] + [[f"start{i}", *own] for i in range(40)] + [own]
    rnd.shuffle(texts)
    texts = [(i, " ".join(w)) for i, w in enumerate(texts)]
    want = brute_classes(texts)
    assert classes_of(spark, texts) == want


def test_alignment_is_by_order():
    rnd = random.Random(4)
    a = sentence(rnd, 200).split()
    b = a[:]
    b[50] = "other"
    turned = a[100:] + a[:100]
    x, y, z = (neardup.labelled([w])[0] for w in (a, b, turned))
    assert neardup.similarity(x, y, 0.8) == pytest.approx(191 / 201)
    assert neardup.similarity(x, x, 0.8) == 1 and neardup.similarity(x, z, 0.8) == 0


# sharding


def test_sharding(docs, texts, empty, odd):
    got = by_id(sharding.assign(docs, 5))
    groups = collections.defaultdict(set)
    slots = collections.defaultdict(list)
    load = collections.Counter()
    for i, t in texts:
        r = got[i]
        size = len((t or "").encode()) + 16
        assert (r.size, r.text_crc32) == (size, zlib.crc32((t or "").encode()))
        groups[t or ""].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += size
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # groups in falling order, each to the least-loaded shard: the loads are those of the plainest version
    weight = collections.Counter()
    for _, t in texts:
        weight[t or ""] += len((t or "").encode()) + 16
    assert sorted(load[k] for k in range(5)) == sorted(plain_loads(weight.values(), 5))
    assert sharding.assign(empty, 5).count() == 0 and sharding.assign(odd, 5).count() == 6


def plain_loads(sizes, shards):
    load = [0] * shards
    for s in sorted(sizes, reverse=True):
        load[load.index(min(load))] += s
    return load


def test_sharding_is_near_even(spark):
    """Thousands of groups of few sizes and some of their own: the loads differ by no more than the least group."""
    rnd = random.Random(3)
    texts = [f"{i:05d}" + "x" * rnd.choice([3, 40, 41, 700]) for i in range(4000)] + [f"{i}y" * rnd.randrange(1, 900) for i in range(200)] + ["z" * 30] * 500
    got = sharding.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 7).groupBy("shard").agg(F.sum("size").alias("load"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    loads = [r.load for r in got]
    assert len(loads) == 7 and max(loads) - min(loads) <= 5 + 3 + 16 and all(r.last == r.n - 1 for r in got)


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_longest_first_is_near_even(shards):
    """Runs of a size, short and long, behind a huge group too, end in the loads of one group after the other."""
    rnd = random.Random(shards)
    for _ in range(40):
        sizes = sorted(rnd.sample(range(1, 1000), 8), reverse=True)
        counts = [rnd.choice([1, 2, 5, 30, 200]) for _ in sizes]
        if rnd.random() < 0.3:
            sizes, counts = [30_000, *sizes], [1, *counts]
        plan = sharding.planned(np.array(sizes), np.array(counts), shards).to_pylist()
        assert [(r["bytes"], r["ends"][-1]) for r in plan] == list(zip(sizes, counts, strict=True))
        loads = [0] * shards
        for r in plan:
            assert r["shards"] == sorted(set(r["shards"]))
            for k, end, before in zip(r["shards"], r["ends"], [0, *r["ends"]], strict=False):
                loads[k] += (end - before) * r["bytes"]
        assert loads == plain_loads([s for s, n in zip(sizes, counts, strict=True) for _ in range(n)], shards)


# packing


def best_fit_decreasing(counts_, capacity):
    free = []
    for length in sorted(counts_, reverse=True):
        for _ in range(counts_[length]):
            fits = [k for k, f in enumerate(free) if f >= length]
            if fits:
                free[min(fits, key=lambda k: free[k])] -= length
            else:
                free.append(capacity - length)
    return len(free)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 20, 64])
    n = collections.Counter(rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 200)))
    made = packing.plan(n, capacity)
    used = collections.defaultdict(list)
    for length, slots in made.slots.items():
        ends = [s[0] for s in slots[1:]] + [n[length]]
        for (rank, first, each, offset), end in zip(slots, ends, strict=True):
            for k in range(end - rank):
                used[first + k // each].append((offset + k % each * length, length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == made.bins == best_fit_decreasing(n, capacity)


def test_pack(docs, texts, empty, odd, monkeypatch):
    tool = Tokenizer.from_file(PATH)
    ids = {i: [*tool.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts}
    rows = packing.pack(docs, PATH, 256).collect()
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 256 * r.piece and len(own) == r.length and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) == best_fit_decreasing(collections.Counter(r.length for r in rows), 256)
    assert packing.pack(empty, PATH, 256).count() == 0 and packing.pack(odd, PATH, 256).count() == 6


# scoring


def brute_lattice(w, pieces, inner):
    forward = [1.0] + [0.0] * len(w)
    for j in range(1, len(w) + 1):
        for i in range(j):
            forward[j] += forward[i] * pieces.get((w[i:j], j == len(w)), 0.0)
    return forward[-1]


def test_lattice_is_the_sum_over_segmentations():
    import json

    vocab = json.load(open(PATH, encoding="utf-8"))["model"]["vocab"]
    of = {c: b for b, c in enumerate(bpe.byte_characters())}
    pieces = {(bytes(of[c] for c in n.removesuffix("</w>")), n.endswith("</w>")): 1 / len(vocab) for n in vocab}
    model = lattice.Pieces.read(PATH)
    words = [b"the", b"nation", "réunion".encode(), b"x", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", bytes(range(200, 220)), b"\xff"]
    got = model.score(words)
    for w, s in zip(words, got, strict=True):
        assert s == pytest.approx(math.log(brute_lattice(w, pieces, model.inner)), rel=1e-9)
    assert model.expected([b"the"], np.array([3])).sum() >= 3


def test_score(spark, docs, texts, empty, odd):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    token = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) for i, t in texts}
    out = {i for i in token if i % 3 == 0}
    seen = collections.Counter(w for i, ws in token.items() if i not in out for w in ws)
    ends = len(token) - len(out)
    n, v = sum(seen.values()) + ends, len(seen) + 1
    got = by_id(lattice.score(docs.withColumn("held_out", F.col("doc_id") % 3 == 0), PATH))
    for i, ws in token.items():
        r = got[i]
        base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.train_tokens == n
        assert (r.n_tokens, r.n_known, r.held_out) == (len(ws) + 1, sum(w in seen for w in ws) + 1, i in out)
        assert r.score < 0
    assert lattice.score(empty.withColumn("held_out", F.lit(False)), PATH).count() == 0
    assert lattice.score(odd.withColumn("held_out", F.lit(True)), PATH).count() == 6


def segmentations(word, pieces):
    """All ways to cut ``word`` into pieces, the last one word-final."""
    out = [[(word, True)]] if (word, True) in pieces else []
    for k in range(1, len(word)):
        if (word[:k], False) in pieces:
            out += [[(word[:k], False), *rest] for rest in segmentations(word[k:], pieces)]
    return out


def test_score_is_the_marginal_probability(spark):
    """Scores of all documents against weights and sums over all segmentations, worked out one by one."""
    import json

    vocab = json.load(open(PATH, encoding="utf-8"))["model"]["vocab"]
    of = {c: b for b, c in enumerate(bpe.byte_characters())}
    final = {n: n.endswith("</w>") and n != "</w>" for n in vocab}
    pieces = {(bytes(of[c] for c in n.removesuffix("</w>" if final[n] else "")), final[n]) for n in vocab}
    train = ["the Nation the nation wide", "the red é wide", None, "then then"]
    asked = ["nation", "unknown wide", "", "thé the", None, "nationwide"]
    words = collections.Counter(w for t in train for w in (t or "").encode().lower().split())
    weight = dict.fromkeys(pieces, 1 / len(vocab))
    for _ in range(lattice.ROUNDS):
        expected = dict.fromkeys(pieces, lattice.ADDED)
        for w, n in words.items():
            ways = [(x, math.prod(weight[p] for p in x)) for x in segmentations(w, pieces)]
            for x, likely in ways:
                for p in x:
                    expected[p] += n * likely / sum(y for _, y in ways)
        total = sum(expected.values())
        weight = {p: x / total for p, x in expected.items()}
    n = sum(words.values())
    rows = [(i, t, False) for i, t in enumerate(train)] + [(i + 10, t, True) for i, t in enumerate(asked)]
    got = {r.doc_id: r.score for r in lattice.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), PATH).collect()}
    for i, t, _ in rows:
        own = [math.log10((n + 1) / (n + 4 + 2) * sum(math.prod(weight[p] for p in x) for x in segmentations(w, pieces))) for w in (t or "").encode().lower().split()]
        assert got[i] == pytest.approx(sum(own) + math.log10((4 + 1) / (n + 4 + 2)), rel=1e-6)


def test_scores_are_probabilities(spark):
    """All one-word texts over a small alphabet have less than all probability, and what training has gets more of it."""
    train = spark.createDataFrame([(0, "a b a"), (1, "a")], "doc_id long, text string").withColumn("held_out", F.lit(False))
    asked = [(k + 2, t) for k, t in enumerate(["", *(chr(c) for c in range(33, 127) if not chr(c).isupper())])]
    rows = lattice.score(train.unionByName(spark.createDataFrame(asked, "doc_id long, text string").withColumn("held_out", F.lit(True))), PATH)
    p = {r.doc_id: 10**r.score for r in rows.filter("held_out").collect()}
    assert sum(p.values()) < 1
    named = {t: p[i] for i, t in asked}
    assert named["a"] > named["b"] > named["c"] > 0


# repeated substrings


def brute_repeats(texts):
    first = {}
    for i, t in sorted((i, t) for i, t in texts):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    out = {}
    for i, t in texts:
        marked = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                marked[p : p + 50] = b"\1" * 50
        out[i] = marked
    return out


def check_repeats(frame, texts):
    texts = [(i, (t or "").encode()) for i, t in texts]
    got = by_id(suffixes.remove_repeats(frame))
    assert len(got) == len(texts)
    for (i, t), marked in zip(texts, brute_repeats(texts).values(), strict=True):
        r = got[i]
        own = bytearray(len(t))
        for a, b in r.spans:
            assert a < b and (a == 0 or not own[a - 1])
            own[a:b] = b"\1" * (b - a)
        assert own == marked, i
        assert bytes(r.kept) == bytes(c for c, m in zip(t, marked, strict=True) if not m) and r.n_bytes == len(t)


def test_remove_repeats(docs, texts, empty, odd):
    check_repeats(docs, texts)
    assert suffixes.remove_repeats(empty).count() == 0
    assert sorted((r.n_bytes, len(r.spans)) for r in suffixes.remove_repeats(odd).collect()) == [(0, 0), (3, 0), (3, 0), (3, 0), (3, 0), (82, 0)]


@pytest.mark.parametrize("bucket", [200, 4 << 20])
def test_remove_repeats_across_buckets_and_pieces(spark, bucket, monkeypatch):
    """Small pieces, chunks and buckets: texts are cut, hot passages with different neighbours lie in several buckets."""
    for name, value in {"PIECE": 700, "CHUNK": 4000, "BUCKET": bucket, "EVERY": 1}.items():
        monkeypatch.setattr(suffixes, name, value)
    rnd = random.Random(8)
    hot = sentence(rnd, 14)
    texts = [(i, sentence(rnd, 10) + " " + hot + " " + (sentence(rnd, 10) if i % 3 else "tail of the same kind in every third text")) for i in range(120)]
    texts += [(i, texts[i - 120][1]) for i in range(120, 140)] + [(200, sentence(rnd, 1500)), (201, "z" * 3000), (202, "z" * 100), (203, "zy" * 900), (204, "")]
    texts += [(205, texts[140][1][1000:5000] + "é" + texts[140][1][300:900])]
    check_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), texts)


def test_without_repeats_keeps_columns(spark):
    passage = "é" * 60
    docs = spark.createDataFrame([(1, "a" + passage, "x", 9, 1), (2, "b" + passage + "c", None, 9, 2), (None, None, "z", 9, 3)], "doc_id long, text string, sha string, n_chars long, chunk int")
    got = {r.chunk: r for r in suffixes.without_repeats(docs).collect()}
    assert suffixes.without_repeats(docs).columns == docs.columns
    assert (got[2].text, got[2].n_chars, got[2].sha) == ("bc", 2, None) and got[1].text == "a" + passage and (got[3].text, got[3].n_chars) == ("", 0)


def test_multikey_sorts_like_bytes():
    rnd = random.Random(1)
    text = bytes(rnd.choice(b"ab") for _ in range(400)) * 2
    raw = np.frombuffer(text + b"\0" * 8, np.uint8)
    at = np.arange(len(text) - 50)
    order, group = suffixes.multikey(raw, at)
    keys = [text[i : i + 50] for i in order.tolist()]
    assert keys == sorted(keys)
    assert all((keys[k] == keys[k + 1]) == (group[k] == group[k + 1]) for k in range(len(keys) - 1))


def test_small_batches_bound_bytes_and_put_the_setting_back(spark):
    from lodestone.llm import scratch

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = spark.range(300, numPartitions=1).select(F.repeat(F.lit("x"), 1000).alias("t"))
    before = spark.conf.get(scratch.BATCH_BYTES, None)
    with pytest.raises(ZeroDivisionError), scratch.small_batches(spark, 50_000):
        got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(got) == 300 and max(got) <= 60
        1 / 0
    assert spark.conf.get(scratch.BATCH_BYTES, None) == before
