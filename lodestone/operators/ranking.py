"""Ranking, fusion and choosing rows within groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, key: str, score: Column, limit: int) -> DataFrame:
    """key and rank (from 1) of the first ``limit`` rows by score, the highest first, ties to the smaller key; no task sorts more rows than that."""
    best = rows.select(key, score.alias("score")).orderBy(F.col("score").desc(), key).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), key)))


def rrf(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (key, rank): key and the sum of 1 / (k + rank)."""
    every = reduce(DataFrame.unionByName, [x.select(key, "rank") for x in lists])
    return every.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"))


def best_per_key(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row with the highest score of each key, ties to the smaller ``tie``; partial maxima are taken before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    top = F.max_by(F.struct(*others), F.struct(F.col(score), -F.col(tie))).alias("top")
    return rows.groupBy(*keys).agg(top).select(*keys, "top.*")


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``, which must be unique in a key."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("top")).select(*keys, "top.*")


def top_per_group(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group in this order, with their rank; Spark limits groups before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def waterfall(tiers: list[DataFrame], key: str, limit: int, *order: Column) -> DataFrame:
    """Rows of the first tier, then of the next ones as far as there is room; a key comes from its first tier only."""
    every = reduce(DataFrame.unionByName, [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)])
    others = [c for c in every.columns if c != key]
    once = every.groupBy(key).agg(F.min_by(F.struct(*others), "tier").alias("top")).select(key, "top.*")
    return once.orderBy("tier", *order).limit(limit)


def positions(rows: DataFrame, groups: list[str], part: Column, *order: Column) -> DataFrame:
    """Adds position: each row's place (from 1) in its group by ``order``.

    ``part`` cuts a group into runs of that order (an hour of a time, a range of a number), so a task
    sorts one part of a group, never a whole hot group. Rows of a null part come first.
    """
    dealt = rows.withColumn("_part", part)
    sizes = dealt.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy(F.col("_part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    renamed = starts.withColumnsRenamed({c: f"_of_{c}" for c in [*groups, "_part"]})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*groups, "_part"]])
    own = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(renamed, same).withColumn("position", F.col("_start") + F.col("_own")).select(*rows.columns, "position")
