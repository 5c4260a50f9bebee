"""Parquet tables with a key that can be loaded, updated and cut down.

Rows lie in buckets by their key's hash.  A change reads and writes only the
buckets its keys fall into; the others stay where they are.  What a change wrote
counts from its commit on (see versions.py); before that a reader, or a job that
starts again after a crash, finds the state before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestone.sources.versions import Versions, remove, seen


class Stored:
    """The table in ``path``; its key and number of buckets are fixed by the first load.

    A bucket should hold some hundred megabytes; the driver holds the list of buckets.  Rows without a key are errors:
    counted and left out.  Names that begin with an underscore are the table's own.  Incoming rows are cast to the
    table's columns; one the table lacks is added to it and null in older rows, one that comes without is null.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.versions = Versions(spark, path)
        _, state = self.versions.last()
        if state and state["key"] != key:
            raise ValueError(f"{path} has the key {state['key']}")
        self.buckets = state["of"] if state else buckets

    def _schema(self, state: dict) -> StructType:
        return StructType.fromJson(state["schema"])

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _rows(self, state: dict, buckets: list[str]) -> DataFrame:
        """Rows of these buckets, with their bucket."""
        schema = self._schema(state)
        paths = [f"{self.path}/data/{state['at'][b]}/_bucket={b}" for b in buckets if b in state["at"]]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("_bucket", F.lit(0))
        return self.spark.read.schema(schema).parquet(*paths).withColumn("_bucket", self._bucket(F.col(self.key)))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, of the last state or of an earlier one."""
        number, state = self.versions.last()
        if version is not None and version != number:
            kept = self.spark.read.text(f"{self.path}/states/{version:012d}.json", wholetext=True).first()
            state = json.loads(kept[0])
        if not state:
            raise ValueError(f"{self.path}: nothing has been loaded")
        return self._rows(state, list(state["at"])).drop("_bucket")

    def _incoming(self, rows: DataFrame, state: dict) -> tuple[DataFrame, StructType, dict, str]:
        """Rows written by bucket, so that they are computed once; the table's columns with theirs; found and errors, counted on the way."""
        schema = self._schema(state) if state else StructType()
        names = {f.name for f in schema}
        for f in rows.schema:
            if f.name not in names:
                schema = schema.add(f.name, f.dataType, True)
        cast = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        watch, place = Observation(), f"{self.path}/incoming/{uuid.uuid4().hex}"
        counted = cast.observe(watch, F.count("*").alias("found"), F.count_if(F.col(self.key).isNull()).alias("errors"))
        counted.filter(F.col(self.key).isNotNull()).withColumn("_bucket", self._bucket(F.col(self.key))).write.parquet(place)
        came = self.spark.read.schema(StructType([*schema, StructField("_bucket", IntegerType())])).parquet(place)
        return came, schema, seen(watch, "found", "errors"), place

    def _commit(self, number: int, state: dict, schema: StructType, rows: DataFrame, touched: list[str], batch: tuple[str, int] | None) -> None:
        """Write the touched buckets anew and make that the state."""
        name = uuid.uuid4().hex
        if touched:
            rows.select(*schema.names, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        full = set(self.versions.names(f"data/{name}"))  # a bucket that lost all its rows has no folder
        at = {b: v for b, v in state.get("at", {}).items() if b not in set(touched)} | {b: name for b in touched if f"_bucket={b}" in full}
        batches = state.get("batches", {}) | ({batch[0]: batch[1]} if batch else {})
        self.versions.commit(number + 1, {"key": self.key, "of": self.buckets, "schema": schema.jsonValue(), "at": at, "batches": batches})

    def _change(self, rows: DataFrame, combine: str, order: Column | None, batch: tuple[str, int] | None, columns: list[str] | None = None) -> dict[str, int]:
        number, state = self.versions.last()
        if batch and state and state["batches"].get(batch[0], -1) >= batch[1]:
            return {"found": 0, "errors": 0, "inserted": 0, "updated": 0, "skipped": 0}
        came, schema, counts, place = self._incoming(rows.withColumn("_order", order) if order is not None else rows.withColumn("_order", F.lit(0)), state)
        columns_ = [f.name for f in schema if f.name != "_order"]
        schema = StructType([f for f in schema if f.name != "_order"])
        touched = [str(r[0]) for r in came.select("_bucket").distinct().collect()]  # as many as there are buckets at most
        there = self._rows(state, touched) if state else self.spark.createDataFrame([], schema).withColumn("_bucket", F.lit(0))
        there = there.select(*[(F.col(f.name) if f.name in there.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema], "_bucket", F.lit(None).cast(came.schema["_order"].dataType).alias("_order"), F.lit(False).alias("_came"))
        # dealt by bucket, which groups by key and writes buckets without a further shuffle
        every = there.unionByName(came.withColumn("_came", F.lit(True))).repartition("_bucket")
        row = F.struct(F.lit(True).alias("_there"), *[c for c in columns_ if c != self.key])
        old, new = F.first(F.when(~F.col("_came"), row), ignorenulls=True), (F.min_by if combine == "insert" else F.max_by)(F.when(F.col("_came"), row), F.when(F.col("_came"), F.struct("_order", row)))
        both = every.groupBy(self.key, "_bucket").agg(old.alias("old"), new.alias("new"), F.count_if("_came").alias("times"))
        was, is_ = F.col("old").isNotNull(), F.col("new").isNotNull()
        if combine == "insert":
            after = F.coalesce("old", "new")
        elif combine == "upsert":
            after = F.coalesce("new", "old")
        else:
            both = both.filter(was)
            after = F.struct(F.lit(True).alias("_there"), *[F.when(is_, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) if c in (columns or []) else F.col(f"old.{c}").alias(c) for c in columns_ if c != self.key])
        watch = Observation()
        both = both.observe(watch, F.count_if(~was & is_).alias("inserted"), F.count_if(was & is_).alias("met"))
        self._commit(number, state, schema, both.select(self.key, "_bucket", after.alias("row")).select(self.key, "_bucket", "row.*"), touched, batch)
        remove(self.spark, place)
        done = seen(watch, "inserted", "met") if touched else {"inserted": 0, "met": 0}
        updated = 0 if combine == "insert" else done["met"]
        return counts | {"inserted": done["inserted"], "updated": updated, "skipped": counts["found"] - counts["errors"] - done["inserted"] - updated}

    def upsert(self, rows: DataFrame, order: Column | None = None, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """Put the rows in place of those with their keys; of incoming rows with one key the last by ``order`` counts (of equals the largest).

        ``batch`` is a stream's name and a number: numbers up to the last one loaded change nothing.  Returns what the
        load itself counted: found, errors (no key), inserted, updated and skipped (came more than once).
        """
        return self._change(rows, "upsert", order, batch)

    def insert(self, rows: DataFrame, order: Column | None = None, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """Add the rows whose key isn't there, of incoming rows with one key the first by ``order``; counts as upsert() has them."""
        return self._change(rows, "insert", order, batch)

    def update(self, changes: DataFrame, columns: list[str], order: Column | None = None) -> dict[str, int]:
        """Give the rows of the changes' keys the changes' values in these columns; keys that aren't there are skipped."""
        return self._change(changes, "update", order, None, columns)

    def delete(self, gone: Column) -> int:
        """Delete the rows for which ``gone`` holds (null: they stay); says how many."""
        number, state = self.versions.last()
        if not state:
            return 0
        rows = self._rows(state, list(state["at"]))
        hit = rows.filter(gone).groupBy("_bucket").agg(F.count("*").alias("n")).collect()  # as many as there are buckets at most
        if hit:
            touched = [str(r[0]) for r in hit]
            self._commit(number, state, self._schema(state), self._rows(state, touched).filter(~F.coalesce(gone, F.lit(False))), touched, None)
        return sum(r.n for r in hit)

    def clean(self) -> int:
        """Delete what no row of the last state is in, and loads that broke off; see Versions.clean()."""
        _, state = self.versions.last()
        return self.versions.clean(set(state.get("at", {}).values())) + self.versions.clean(set(), "incoming")
