"""The stages one after the other against brute force on what each was given."""

from __future__ import annotations

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import queries

from .test_llm import brute_classes, brute_repeats


def test_stages(spark, small):
    given = spark.read.parquet(f"{small}/documents.parquet")
    columns = given.columns
    docs = given
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, small)
        rows = out.collect()
        if name == "best_fit":
            assert {r.doc_id for r in rows} == set(before)
            break
        assert out.columns == columns
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "language_id":
            lettered = {i for i, r in before.items() if any(c.isalpha() for c in r.text)}
            assert len(after) >= 0.98 * len(lettered)
        if name == "exact_dedup":
            groups = collections.defaultdict(list)
            for i, r in before.items():
                groups[r.text.encode().lower()].append(i)
            assert set(after) == {max(x) for x in groups.values()}
        if name == "near_dedup":
            assert set(after) == {min(x) for x in brute_classes([(i, r.text) for i, r in before.items()])}
        if name == "suffix_dedup":
            marked = brute_repeats([(i, r.text.encode()) for i, r in before.items()])
            for i, r in before.items():
                kept = bytes(c for c, m in zip(r.text.encode(), marked[i], strict=True) if not m)
                assert after[i].text == kept.decode(errors="ignore") and after[i].n_chars == len(after[i].text)
            assert set(after) == set(before)
        docs = spark.createDataFrame(rows, out.schema)


def test_run_and_registry(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert names == [f"op{k}" for k in range(1, 14)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_oracles(spark, small):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        ours, theirs = queries.QUERIES[name](spark, small), con.sql(sql)
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        assert sorted(map(str, map(tuple, ours.select(*columns).collect()))) == sorted(map(str, theirs.select(", ".join(f'"{c}"' for c in columns)).fetchall())), name


def test_stages_with_odd_rows_and_clashing_columns(spark, tmp_path):
    """Each stage in turn over nulls, blanks, repeated ids, copies, a very long text and columns named as the operators name theirs; and over no rows."""
    import random

    from .test_llm import CLASHING, sentence

    rnd = random.Random(31)
    base = [sentence(rnd, 60) for _ in range(12)]
    passage = sentence(rnd, 60)
    rows = [(i, t, "aa") for i, t in enumerate(base)] + [(20, base[2].encode().upper().decode(), None), (21, base[3] + " more", "aa"), (22, None, "aa"), (23, "", None), (24, " \n", "aa"), (25, "7", "aa")]
    rows += [(26, base[5] + " " + passage + " " + base[6], "aa"), (27, passage + " " + base[7], "aa"), (4, sentence(rnd, 50), "aa"), (None, sentence(rnd, 40), None)]
    rows.append((30, (sentence(rnd, 3000) + " ") * 550, "aa"))
    assert len(rows[-1][1]) > 10_000_000 // 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit("own"))
    columns, ids = docs.columns, {}
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        docs.write.parquet(f"{path}-in")
        out = stage(spark, spark.read.parquet(f"{path}-in"), str(tmp_path))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        ids[name] = sorted(-1 if r.doc_id is None else r.doc_id for r in docs.select("doc_id").collect())
        if name != "best_fit":
            assert docs.columns == columns and docs.filter(" OR ".join(f"{c} <> 'own'" for c in CLASHING)).count() == 0
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    good = [-1, 0, 1, 2, 3, 4, 4, *range(5, 12), 20, 21, 26, 27, 30]
    assert ids["language_id"] == good
    good.remove(2)  # of equal texts the largest doc_id stays
    assert ids["exact_dedup"] == good
    good.remove(21)  # of near copies the smallest
    assert ids["near_dedup"] == ids["suffix_dedup"] == good and sorted(set(ids["best_fit"])) == sorted(set(good))
    cut = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/suffix_dedup").filter("doc_id IN (26, 27)").collect()}
    assert passage not in cut[27].text and cut[27].n_chars == len(cut[27].text) and base[5] not in cut[26].text and passage in cut[26].text
