"""Joins and loads that keep tables free of repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranking import positions
from lodestone.sources.versions import new_folder, written


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows of which no key is in ``existing`` yet; each key is its own equi-join. Null keys match nothing."""
    out = incoming
    for key in keys:
        out = out.join(existing.select(key).distinct(), key, "left_anti")
    return out


def insert_in_order(incoming: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The incoming rows that come in when rows are inserted one by one by ``order``, each only if none of its keys is there yet.

    A row whose key an earlier incoming row has taken stays out, and takes nothing itself.  In each round, the rows that
    are first among the undecided ones in all of their keys come in, and the rows that share a key with them are out;
    rows wait as long as an earlier undecided row has one of their keys.  Rounds are half the length of the longest chain
    of rows each of which waits for the one before, at most; a round shuffles what is undecided.  ``order`` is unique and
    not null.  Null keys are never taken and match nothing.
    """
    spark = incoming.sparkSession
    place = new_folder(spark, "insert")
    names = [f"_key{i}" for i in range(len(keys))]
    undecided = written(new_rows(incoming, existing, keys).select(order, *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]), f"{place}-0")
    chosen, number = [], 0
    while not undecided.isEmpty():
        number += 1
        state = undecided
        for name in names:  # the first undecided row of each key
            first = undecided.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias(f"{name}_of")).agg(F.min(order).alias(f"{name}_first"))
            state = state.join(first, F.col(name) == F.col(f"{name}_of"), "left").drop(f"{name}_of")
        mine = reduce(Column.__and__, [F.col(name).isNull() | (F.col(f"{name}_first") == F.col(order)) for name in names])
        state = written(state.withColumn("_in", mine).select(order, *names, "_in"), f"{place}-{number}")
        chosen.append(state.filter("_in").select(order))
        undecided = new_rows(state.filter("NOT _in"), state.filter("_in"), names).drop("_in")
    out = reduce(DataFrame.unionByName, chosen) if chosen else undecided.select(order)
    return incoming.join(out, order, "left_semi")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key by ``version``; columns that one side lacks are null there."""
    every = existing.unionByName(incoming, allowMissingColumns=True)
    others = [c for c in every.columns if c != key]
    return every.groupBy(key).agg(F.max_by(F.struct(*others), version).alias("last")).select(key, "last.*").select(*every.columns)


def evolve(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add the columns that are missing, and put their defaults where they are null."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    return rows


def in_order(ids: DataFrame, rows: DataFrame, key: str, listed: str = "ids") -> DataFrame:
    """The rows of a list of keys, with their place in it."""
    return ids.select(F.posexplode(listed).alias("pos", key)).join(rows, key)


def expand_graph(starts: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """One step along typed edges from each query's nodes.

    starts: query, pos, node. edges: src, kind, pos, dst. Returns query, node
    and place: the starts first, then their neighbours by start, kind (in the given order) and pos; a node stands
    where it comes first. Nodes without edges stay.

    The neighbours of a query with one start have the places that they have among the start's own, so those are
    numbered once for each node, and what the queries find isn't shuffled; only queries with several starts merge theirs.
    """
    spark = starts.sparkSession
    number = F.count("*").over(Window.partitionBy("query"))
    starts = written(starts.select("query", "node", F.col("pos").cast("long").alias("pos")).withColumn("alone", number == 1), new_folder(spark, "starts"))
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    edges = edges.filter(F.col("kind").isin(kinds)).select("src", "dst", order.cast("long").alias("b"), F.col("pos").cast("long").alias("c"))
    alone, several = starts.filter("alone"), starts.filter("NOT alone")
    own = edges.filter(~F.col("dst").eqNullSafe(F.col("src"))).withColumn("first", F.row_number().over(Window.partitionBy("src", "dst").orderBy("b", "c"))).filter("first = 1")
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("b", "c", "dst")) + 1)
    found = alone.select("query", "node", F.lit(1).alias("place"))
    found = found.unionByName(alone.join(own.select("src", "dst", "place"), F.col("node") == F.col("src")).select("query", F.col("dst").alias("node"), "place"))
    if several.isEmpty():
        return found
    zero = F.lit(0).cast("long")
    stay = several.select("query", "node", F.struct(F.lit(0).alias("step"), F.col("pos").alias("a"), zero.alias("b"), zero.alias("c")).alias("at"))
    near = several.select("query", F.col("node").alias("src"), F.col("pos").alias("a")).join(edges, "src")
    near = near.select("query", F.col("dst").alias("node"), F.struct(F.lit(1).alias("step"), "a", "b", "c").alias("at"))
    merged = stay.unionByName(near).repartition("query").groupBy("query", "node").agg(F.min("at").alias("at"))
    return found.unionByName(merged.select("query", "node", F.row_number().over(Window.partitionBy("query").orderBy("at", "node")).alias("place")))


def with_fallback(rows: DataFrame, group: str, keep: str) -> DataFrame:
    """Of each group the rows for which ``keep`` holds, or all of them where it holds for none; rows of a null group are a group too."""
    some = rows.groupBy(F.col(group).alias("_group")).agg(F.max(F.expr(keep).cast("int")).alias("_some"))
    found = rows.join(some, F.col(group).eqNullSafe(F.col("_group")))
    return found.filter(F.expr(keep) | (F.col("_some") == 0) | F.col("_some").isNull()).drop("_some", "_group")


def small(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """``rows`` marked for broadcast if they are no more than ``most``, counted, else as they are."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def parts_of(rows: DataFrame, text: str, most: int = 16 << 20) -> int:
    """Into how many parts ``rows`` have to be dealt for ``most`` bytes of ``text`` a part (a pass over the texts counts them), so that a part is no larger in a larger table; one for each core at least."""
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(-(-total // most), rows.sparkSession.sparkContext.defaultParallelism)


def append_counted(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to append (of which no key is there yet; of incoming rows with the same keys one) and one row of counts: found, inserted, skipped."""
    fresh = written(new_rows(incoming.dropDuplicates(keys), existing, keys), new_folder(incoming.sparkSession, "fresh"))
    counts = incoming.agg(F.count("*").alias("found")).crossJoin(fresh.agg(F.count("*").alias("inserted")))  # a row each
    return fresh, counts.withColumn("skipped", F.col("found") - F.col("inserted"))


def with_ids(rows: DataFrame, existing: DataFrame, id: str, part: Column, *order: Column) -> DataFrame:
    """``rows`` with new ids after the largest one of ``existing`` (from 1 if there is none), in this order; see ranking.positions() for ``part``."""
    last = existing.agg(F.coalesce(F.max(id), F.lit(0)).alias("_last"))  # one row
    numbered = positions(rows.withColumn("_all", F.lit(0)), ["_all"], part, *order)
    return numbered.crossJoin(F.broadcast(last)).withColumn(id, F.col("_last") + F.col("position")).drop("_all", "_last", "position")


def update(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with the columns of the changes of their key where there are some (at most one a key); adds changed."""
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("changed"))
    out = rows.join(new, F.col(key) == F.col("_key"), "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    return out.withColumns({c: F.when(F.col("changed"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*rows.columns, "changed")


def deleted(rows: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for which ``gone`` doesn't hold (null: they stay), to be written in place of the old ones, and one row of counts: before, deleted."""
    gone = F.coalesce(gone, F.lit(False))
    return rows.filter(~gone), rows.agg(F.count("*").alias("before"), F.count_if(gone).alias("deleted"))


def fill_blanks(rows: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with the other table's value wherever theirs is null or blank; ``other`` has at most one row a key."""
    more = other.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    blank = {c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in columns}
    out = rows.join(more, F.col(key) == F.col("_key"), "left")
    return out.withColumns({c: F.when(blank[c], F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)) for c in columns}).select(*rows.columns)


def where_if(rows: DataFrame, column: str, wanted: object, every: object = "All") -> DataFrame:
    """``rows`` with this value, or all of them if ``wanted`` is null or the word for all."""
    return rows if wanted is None or wanted == every else rows.filter(F.col(column) == F.lit(wanted))


def joined_lines(rows: DataFrame, group: str, order: str, text: str, open: Column) -> DataFrame:
    """group, order and text of each line; a line for which ``open`` holds takes the next one of its group with it, which then is no line of its own.

    A line that has been taken takes none. ``order`` is unique in its group; a last open line stays as it is; a null ``open`` counts as false.
    """
    lines = Window.partitionBy(group).orderBy(order)
    runs = rows.select(group, order, text, F.coalesce(open, F.lit(False)).alias("_open"))
    runs = runs.withColumn("_run", F.sum((~F.col("_open")).cast("int")).over(lines))  # open lines in a row have the number of the closed one before them
    place = F.row_number().over(Window.partitionBy(group, "_run", "_open").orderBy(order))
    first = runs.withColumn("_first", F.col("_open") & (place % 2 == 1))
    next_, taken = F.lead(text).over(lines), F.coalesce(F.lag("_first").over(lines), F.lit(False))
    both = F.when(F.col("_first") & next_.isNotNull(), F.concat(F.col(text), F.lit(" "), next_)).otherwise(F.col(text))
    return first.select(group, order, both.alias("_text"), taken.alias("_taken")).filter("NOT _taken").select(group, order, F.col("_text").alias(text))
