"""Tables with a key, against dicts; crashes between data and commit; segments of a text index; rows inserted one by one."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators import relations
from lodestone.operators.text_index import TextIndex
from lodestone.sources.stored import Stored
from lodestone.sources.versions import Versions


def rows_of(table, key="k"):
    rows = table.read().collect()
    out = {r[key]: r.asDict() for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, n int").repartition(3)


def test_loads_updates_and_deletes(spark, tmp_path):
    t = Stored(spark, str(tmp_path), "k", buckets=7)
    first = [(i, f"a{i}", i) for i in range(40)] + [(3, "z", 9), (None, "no", 0), (None, None, None)]
    assert t.insert(frame(spark, first), F.col("v")) == {"found": 43, "errors": 2, "inserted": 40, "updated": 0, "skipped": 1}
    want = {i: {"k": i, "v": f"a{i}", "n": i} for i in range(40)}
    assert rows_of(t) == want
    assert t.insert(frame(spark, [(39, "x", 1), (40, "x", 1), (40, "y", 2)]), F.col("n")) == {"found": 3, "errors": 0, "inserted": 1, "updated": 0, "skipped": 2}
    want[40] = {"k": 40, "v": "x", "n": 1}
    assert rows_of(t) == want
    assert t.upsert(frame(spark, [(1, "new", 5), (1, "newer", 6), (77, None, None)]), F.col("n")) == {"found": 3, "errors": 0, "inserted": 1, "updated": 1, "skipped": 1}
    want[1], want[77] = {"k": 1, "v": "newer", "n": 6}, {"k": 77, "v": None, "n": None}
    assert rows_of(t) == want
    assert t.update(frame(spark, [(2, "u", 100), (500, "u", 100)]), ["n"]) == {"found": 2, "errors": 0, "inserted": 0, "updated": 1, "skipped": 1}
    want[2]["n"] = 100
    assert rows_of(t) == want
    assert t.delete(F.col("n") >= 30) == 11 and t.delete(F.col("n") >= 30) == 0
    want = {k: r for k, r in want.items() if r["n"] is None or r["n"] < 30}
    assert rows_of(t) == want
    wider = spark.createDataFrame([(5, 1.5), (900, 2.5)], "k int, more double")
    assert t.upsert(wider)["inserted"] == 1  # another type of key, a column more, two less
    want = {k: r | {"more": None} for k, r in want.items()} | {5: {"k": 5, "v": None, "n": None, "more": 1.5}, 900: {"k": 900, "v": None, "n": None, "more": 2.5}}
    assert rows_of(t) == want and rows_of(Stored(spark, str(tmp_path), "k")) == want
    assert t.clean() > 0 and rows_of(t) == want
    assert t.delete(F.lit(True)) == len(want) and t.read().count() == 0
    with pytest.raises(ValueError):
        Stored(spark, str(tmp_path), "v")


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = Stored(spark, str(tmp_path), "k", buckets=16)
    t.insert(frame(spark, [(i, "a", i) for i in range(200)]))
    before = t.versions.last()[1]["at"]
    t.upsert(frame(spark, [(7, "b", 0)]))
    after = t.versions.last()[1]["at"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert t.read(version=1).filter("k = 7").first().v == "a" and t.read().filter("k = 7").first().v == "b"


def test_a_crash_before_the_commit_loses_nothing(spark, tmp_path, monkeypatch):
    t = Stored(spark, str(tmp_path), "k", buckets=4)
    t.insert(frame(spark, [(i, "a", i) for i in range(20)]))
    want, load = rows_of(t), frame(spark, [(3, "b", 0), (30, "b", 0)])
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        for change in (lambda: t.upsert(load), lambda: t.delete(F.col("k") < 9)):
            with pytest.raises(OSError):
                change()
    assert rows_of(t) == want
    assert t.upsert(load)["inserted"] == 1 and rows_of(t) == want | {3: {"k": 3, "v": "b", "n": 0}, 30: {"k": 30, "v": "b", "n": 0}}
    number, state = t.versions.last()
    with pytest.raises(FileExistsError):
        t.versions.commit(number, state)  # a second writer that began from the state before


def test_a_batch_counts_once(spark, tmp_path):
    t = Stored(spark, str(tmp_path), "k")
    one = frame(spark, [(1, "a", 1)])
    assert t.upsert(one, batch=("s", 0))["inserted"] == 1
    version = t.versions.last()[0]
    assert t.upsert(frame(spark, [(1, "b", 2)]), batch=("s", 0))["updated"] == 0 and t.versions.last()[0] == version
    assert t.upsert(frame(spark, [(1, "b", 2)]), batch=("s", 1))["updated"] == 1 and t.upsert(one, batch=("other", 0))["updated"] == 1


def test_empty_and_key_only_tables(spark, tmp_path):
    t = Stored(spark, f"{tmp_path}/a", "k")
    with pytest.raises(ValueError):
        t.read()
    assert t.delete(F.lit(True)) == 0
    assert t.insert(frame(spark, []))["found"] == 0 and t.read().count() == 0 and t.read().columns == ["k", "v", "n"]
    keys = Stored(spark, f"{tmp_path}/b", "k")
    assert keys.insert(spark.createDataFrame([("x",), ("y",), ("x",)], "k string")) == {"found": 3, "errors": 0, "inserted": 2, "updated": 0, "skipped": 1}
    assert {r.k for r in keys.read().collect()} == {"x", "y"}


WORDS = "alpha beta gamma delta eps zeta eta theta".split()


def texts(rnd, ids):
    return [(i, None if i % 13 == 0 else " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(12)))) for i in ids]


def scored(spark, docs, path, query):
    index = TextIndex(spark, path)
    index.rebuild(docs)
    return {r.doc_id: r.score for r in index.search(query, 50).collect()}, index.sizes()


def test_segments_add_up_to_a_rebuild(spark, tmp_path):
    rnd = random.Random(3)
    every = texts(rnd, range(90))
    docs = spark.createDataFrame([*every, (None, "alpha"), (5, "zzz")], "doc_id long, text string")
    once = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"))
    index, query = TextIndex(spark, f"{tmp_path}/i"), ["alpha", "eps", "nowhere"]
    assert index.search(query, 5).count() == 0 and index.sizes() == (0, 0)
    assert [index.add(docs.filter(f"doc_id < {n} OR doc_id IS NULL")) for n in (30, 60, 91)] == [30, 30, 30] and index.add(docs) == 0
    state = index.versions.last()[1]
    assert [s["docs"] for s in state["segments"]] == [30, 30, 30]

    def same(wanted):
        want, sizes = scored(spark, wanted, f"{tmp_path}/{rnd.random()}", query)
        assert {r.doc_id: r.score for r in index.search(query, 50).collect()} == want and index.sizes() == sizes and len(want) > 10

    same(once)
    gone = docs.filter("doc_id IN (1, 2, 35, 36, 61, 88)").select("doc_id")
    assert index.remove(gone) == 6 and index.remove(gone) == 0
    same(once.filter("doc_id NOT IN (1, 2, 35, 36, 61, 88)"))
    back = spark.createDataFrame([(2, "alpha alpha"), (35, "eps")], "doc_id long, text string")
    assert index.add(back) == 2  # they were gone
    now = once.filter("doc_id NOT IN (1, 2, 35, 36, 61, 88)").unionByName(back)
    same(now)
    assert index.merge(2) == 2
    same(now)
    assert index.remove(now.filter("doc_id IN (2, 50)").select("doc_id")) == 2
    same(now.filter("doc_id NOT IN (2, 50)"))
    assert index.merge() == 3 and len(index.versions.last()[1]["segments"]) == 1 and not index.versions.last()[1]["gone"]
    same(now.filter("doc_id NOT IN (2, 50)"))
    assert index.clean() > 3
    same(now.filter("doc_id NOT IN (2, 50)"))


def test_a_crash_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(texts(random.Random(4), range(1, 40)), "doc_id long, text string")
    index = TextIndex(spark, str(tmp_path))
    index.add(docs.filter("doc_id < 20"))
    want = sorted(map(tuple, index.search(["alpha"], 9).collect()))
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        for change in (lambda: index.add(docs), lambda: index.merge(), lambda: index.rebuild(docs), lambda: index.remove(docs)):
            with pytest.raises(OSError):
                change()
    assert sorted(map(tuple, index.search(["alpha"], 9).collect())) == want
    assert index.add(docs) == 20


def test_expanded_query(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "delta"), (4, "alpha beta delta delta")], "doc_id long, text string")
    index = TextIndex(spark, str(tmp_path))
    index.add(docs)
    best = {r.doc_id: r.score for r in index.scores({"alpha": 1.0}).collect()}
    split = {r.doc_id: r.t for r in docs.select("doc_id", tokens("text").alias("t")).collect()}
    total = sum(best.values())
    weights = {t: sum(s / total * split[i].count(t) / len(split[i]) for i, s in best.items()) for t in ("alpha", "beta", "gamma", "delta")}
    heavy = sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:3]
    want = {"alpha": 0.5}
    for t, w in heavy:
        want[t] = want.get(t, 0) + 0.5 * w / sum(w for _, w in heavy)
    got = index.expanded(["alpha"], terms=3)
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-6 for t in want) and len(want) == 3


def plain_insert(incoming, existing, keys):
    taken = [{e[k] for e in existing if e[k] is not None} for k in keys]
    out = set()
    for row in sorted(incoming, key=lambda r: r["at"]):
        if not any(row[k] in t for k, t in zip(keys, taken, strict=True)):
            out.add(row["at"])
            for k, t in zip(keys, taken, strict=True):
                if row[k] is not None:
                    t.add(row[k])
    return out


@pytest.mark.parametrize("case", ["random", "chain", "hot", "three", "none"])
def test_rows_come_in_one_by_one(spark, case):
    rnd = random.Random(case)
    keys = ["a", "b", "c"] if case == "three" else ["a", "b"]
    if case == "chain":  # each row waits for the one before
        rows = [{"at": i, "a": (i + 1) // 2, "b": i // 2} for i in range(16)]
    elif case == "hot":
        rows = [{"at": i, "a": 0 if rnd.random() < 0.6 else i, "b": rnd.randrange(60)} for i in range(200)]
    else:
        rows = [{"at": i, **{k: None if rnd.random() < 0.1 else rnd.randrange(30) for k in keys}} for i in range(0 if case == "none" else 150)]
    rnd.shuffle(rows)
    there = [{k: rnd.randrange(30) for k in keys} for _ in range(0 if case == "chain" else 4)]
    kind = ", ".join(f"{k} int" for k in keys)
    incoming = spark.createDataFrame([(r["at"], *(r[k] for k in keys), "x") for r in rows], f"at int, {kind}, _note string")
    existing = spark.createDataFrame([tuple(r[k] for k in keys) for r in there], kind)
    got = relations.insert_in_order(incoming, existing, keys, "at").collect()
    assert {r["at"] for r in got} == plain_insert(rows, there, keys) and len(got) == len({r["at"] for r in got})
    for k in keys:
        held = [r[k] for r in got if r[k] is not None]
        assert len(held) == len(set(held))


def test_parts_of_an_index_have_so_many_bytes(spark, tmp_path, monkeypatch):
    """100 MB of text in a session of four shuffle partitions: more parts than these; many hidden documents, too many for a broadcast, are hidden all the same."""
    from lodestone.operators import text_index

    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.concat(F.repeat(F.lit("x"), F.lit(1000)), F.lit(" ")), F.lit(1000)), F.concat(F.lit("end w"), (F.col("id") % 7).cast("string"))).alias("text"))
    index = TextIndex(spark, f"{tmp_path}/i")
    assert index.add(docs) == 100
    name = index._state()[1]["segments"][0]["name"]
    assert sum(f.name.startswith("part-") for f in (tmp_path / "i" / "data" / name).iterdir()) > 4
    monkeypatch.setattr(text_index, "HIDDEN", 3, raising=False)
    assert index.remove(docs.filter("doc_id % 2 = 0")) == 50 and index.add(docs.filter("doc_id = 4")) == 1
    assert {r.doc_id for r in index.search(["w3", "w4"], 100).collect()} == {i for i in range(100) if (i % 2 or i == 4) and i % 7 in (3, 4)}
    assert index.documents().count() == 51 and index.merge() == 2 and index.documents().count() == 51 and index.sizes()[0] == 51
