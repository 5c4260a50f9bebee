"""Every query of the catalog against its SQL in DuckDB."""

import duckdb
import pytest

from lodestone.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(pdf, columns):
    return sorted(map(str, pdf[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, small, duck, name):
    ours, theirs = QUERIES[name](spark, small).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)


def test_passages_at_edges_and_short_ones(spark, tmp_path):
    """Passages behind a quote, before punctuation, inside words, across lines, of one to eight words, and empty."""
    passages = ["one two three four five six seven eight", "one two three four five", "one two three four", "two three four", "two three", "three", "hree fou", "", "one  two", "a b c", "five six seven eight nine", "four\nfive six"]
    texts = ["one two three four five six seven eight", 'x "one two three four five six seven eight" y', "one two three four five, six", "(one two three four)", "athree four", "", "three", "one  two three\nfour five", "xa b cx", "a  b c", "one two\nthree four five six seven eight", "three four\nfive six", None]
    con = duckdb.connect()
    for name, key, values in (("benchmark", "item_id", passages), ("documents", "doc_id", texts)):
        spark.createDataFrame(list(enumerate(values)), f"{key} long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    ours = sorted(map(tuple, QUERIES["passage_verify"](spark, str(tmp_path)).select("item_id", "doc_id").collect()))
    assert len(ours) > 30 and ours == sorted(con.sql(ORACLE_SQL["passage_verify"]).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
