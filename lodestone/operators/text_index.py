"""A kept text index: immutable segments of postings, and what they add up to.

Documents that come in make a segment of their own and are tokenised once, then.
A segment's postings are sorted by term, so a search reads the row groups of its
terms; a posting of the empty term stands for each document.  Numbers of
documents and tokens stand in the index's state and are added up over segments.
Documents that go are named in a list that hides them from the segments before
it, until segments are merged.  Every change is a new state (see versions.py);
searches of an older state go on.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.text import tokens
from lodestone.operators.ranking import ranked
from lodestone.operators.relations import parts_of
from lodestone.sources.versions import Versions, seen

#: Parts into which a term's postings are dealt, so that no task gets all documents that have a common term.
PARTS = 32
#: Postings of a part of a segment or of a shuffle, at most about; documents that are hidden by a broadcast, at most.
POSTINGS, HIDDEN = 2_500_000, 100_000


class TextIndex:
    """The index in ``path``. Null keys aren't indexed; null texts are documents without a term; of rows with one key one is taken (the smallest text)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", text: str = "text"):
        self.spark, self.path, self.key, self.text = spark, path.rstrip("/"), key, text
        self.versions = Versions(spark, path)

    def _postings(self, state: dict, every: bool = False) -> DataFrame:
        """term, key, n and tf of the documents that are there; with ``every`` of hidden ones too, and the segment's number."""
        schema = StructType.fromJson(state["schema"])
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/data/{s['name']}").withColumn("_segment", F.lit(s["number"])) for s in state["segments"]]
        rows = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema).withColumn("_segment", F.lit(0))
        return rows if every else self._visible(rows, state, self._size(state))

    @staticmethod
    def _size(state: dict, *of: str) -> int:
        return sum(s[x] for s in state["segments"] for x in of or ("docs", "tokens"))

    def _parts(self, rows: int) -> int:
        return max(-(-rows // POSTINGS), self.spark.sparkContext.defaultParallelism)

    def _visible(self, rows: DataFrame, state: dict, size: int) -> DataFrame:
        """``rows`` (no more than ``size``) of the segments without those that are hidden."""
        if state["gone"]:
            lists = [self.spark.read.parquet(f"{self.path}/data/{g['name']}").select(F.col(self.key).alias("_gone"), F.lit(g["before"]).alias("_before")) for g in state["gone"]]
            gone = reduce(DataFrame.unionByName, lists)
            if sum(g["docs"] for g in state["gone"]) <= HIDDEN and gone.limit(HIDDEN + 1).count() <= HIDDEN:
                gone = F.broadcast(gone)
            else:
                rows, gone = rows.repartition(self._parts(size), self.key), gone.repartition(self._parts(size), "_gone")
            rows = rows.join(gone, (F.col(self.key) == F.col("_gone")) & (F.col("_segment") < F.col("_before")), "left_anti")
        return rows.drop("_segment")

    def _state(self) -> tuple[int, dict]:
        number, state = self.versions.last()
        return number, state or {"segments": [], "gone": [], "schema": None, "next": 1}

    def documents(self, state: dict | None = None) -> DataFrame:
        """Key and n (terms) of every document that is there."""
        state = state or self._state()[1]
        return self._visible(self._postings(state, every=True).filter("term = ''"), state, self._size(state, "docs")).select(self.key, "n")

    def sizes(self) -> tuple[int, int]:
        """How many documents and tokens are there, from the state alone."""
        _, state = self._state()
        return tuple(sum(s[x] for s in state["segments"]) - sum(g[x] for g in state["gone"]) for x in ("docs", "tokens"))

    def _segment(self, docs: DataFrame, number: int, there: DataFrame | None = None) -> tuple[dict, StructType]:
        """Tokenise ``docs``, one row a key, without those that are there, and write them as a segment.

        Parts are of so many bytes of text, so no task holds more in a larger table; a key's postings are counted where its text is.
        """
        watch, name, parts = Observation(), uuid.uuid4().hex, parts_of(docs, self.text)
        docs = docs.filter(F.col(self.key).isNotNull()).select(self.key, self.text).repartition(parts, self.key).groupBy(self.key).agg(F.min(self.text).alias(self.text))
        if there is not None:
            docs = docs.join(there.repartition(parts, self.key), self.key, "left_anti")
        words = docs.select(self.key, F.coalesce(tokens(self.text), F.array().cast("array<string>")).alias("words")).withColumn("n", F.size("words"))
        words = words.observe(watch, F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
        rows = words.select(self.key, "n", F.explode(F.concat("words", F.array(F.lit("")))).alias("term")).groupBy("term", self.key, "n").agg(F.count("*").alias("tf"))
        part = F.pmod(F.xxhash64(self.key), F.lit(PARTS))
        rows.repartition(parts, "term", part).sortWithinPartitions("term", self.key).write.parquet(f"{self.path}/data/{name}")
        return {"name": name, "number": number, **seen(watch, "docs", "tokens")}, rows.schema

    def add(self, docs: DataFrame) -> int:
        """Index the documents whose key isn't there; says how many came in."""
        number, state = self._state()
        segment, schema = self._segment(docs, state["next"], self.documents(state).select(self.key) if state["segments"] else None)
        if segment["docs"]:
            self.versions.commit(number + 1, state | {"segments": [*state["segments"], segment], "schema": schema.jsonValue(), "next": state["next"] + 1})
        return segment["docs"]

    def remove(self, keys: DataFrame) -> int:
        """Take the documents with these keys out; says how many were there."""
        number, state = self._state()
        if not state["segments"]:
            return 0
        watch, name = Observation(), uuid.uuid4().hex
        gone = self.documents(state).join(keys.select(self.key), self.key, "left_semi").observe(watch, F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
        gone.write.parquet(f"{self.path}/data/{name}")
        found = seen(watch, "docs", "tokens")
        if found["docs"]:
            self.versions.commit(number + 1, state | {"gone": [*state["gone"], {"name": name, "before": state["next"], **found}], "next": state["next"] + 1})
        return found["docs"]

    def merge(self, most: int | None = None) -> int:
        """Make one segment of all, or of the ``most`` smallest ones, without what is hidden in them; says of how many. No text is read."""
        number, state = self._state()
        chosen = sorted(state["segments"], key=lambda s: (s["docs"], s["number"]))[:most]
        if not chosen:
            return 0
        names = {s["name"] for s in chosen}
        rest = [s for s in state["segments"] if s["name"] not in names]
        rows, watch, name = self._postings(state | {"segments": chosen}), Observation(), uuid.uuid4().hex
        every = F.when(F.col("term") == "", F.col("n"))
        part = F.pmod(F.xxhash64(self.key), F.lit(PARTS))
        rows.observe(watch, F.count(every).alias("docs"), F.coalesce(F.sum(every), F.lit(0)).alias("tokens")).repartition(self._parts(self._size({"segments": chosen})), "term", part).sortWithinPartitions("term", self.key).write.parquet(f"{self.path}/data/{name}")
        one = {"name": name, "number": state["next"], **seen(watch, "docs", "tokens")}
        # a list still hides what lies in the other segments; its numbers are those of what it still hides
        gone = []
        for g in state["gone"] if rest else []:
            before = self._postings(state | {"segments": rest}, every=True).filter((F.col("term") == "") & (F.col("_segment") < g["before"]))
            left = self._visible(before, state | {"gone": [x for x in state["gone"] if x["before"] < g["before"]]}, self._size({"segments": rest}, "docs")).select(self.key, "n")
            hidden = left.join(self.spark.read.parquet(f"{self.path}/data/{g['name']}").select(self.key), self.key, "left_semi").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
            gone.append(g | hidden.asDict())
        self.versions.commit(number + 1, state | {"segments": [*rest, one], "gone": [g for g in gone if g["docs"]], "next": state["next"] + 1})
        return len(chosen)

    def rebuild(self, docs: DataFrame) -> int:
        """Index ``docs`` anew, in place of all that is there; until that is done, searches find what was there."""
        number, state = self._state()
        segment, schema = self._segment(docs, state["next"])
        self.versions.commit(number + 1, {"segments": [segment], "gone": [], "schema": schema.jsonValue(), "next": state["next"] + 1})
        return segment["docs"]

    def clean(self) -> int:
        """Delete what the last state doesn't name; see Versions.clean()."""
        _, state = self._state()
        return self.versions.clean({x["name"] for x in [*state["segments"], *state["gone"]]})

    def scores(self, query: dict[str, float], keep: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """Key and score of every document that has one of the query's terms: BM25 with a weight for each term.

        The terms' statistics are those of all documents; ``keep`` (keys) then says which of them are scored.
        """
        _, state = self._state()
        docs, total = self.sizes()
        if not docs or not query:
            return (self._postings(state) if state["segments"] else self.spark.createDataFrame([], f"{self.key} long")).limit(0).select(self.key, F.lit(0.0).alias("score"))
        hit = self._postings(state).filter(F.col("term").isin(list(query)) & (F.col("term") != ""))
        df = hit.groupBy("term").agg(F.count("*").alias("df"))  # a row for each of the query's terms
        weight = F.create_map(*[x for t, w in query.items() for x in (F.lit(t), F.lit(float(w)))])
        idf = F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        each = weight[F.col("term")] * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(max(total, 1) / docs)))
        if keep is not None:
            hit = hit.join(keep.select(self.key).distinct(), self.key, "left_semi")
        return hit.join(F.broadcast(df), "term").groupBy(self.key).agg(F.round(F.sum(each), 6).alias("score"))

    def search(self, query: list[str] | dict[str, float], k: int, keep: DataFrame | None = None) -> DataFrame:
        """key, score and rank of the k best documents."""
        query = query if isinstance(query, dict) else dict.fromkeys(query, 1.0)
        scores = self.scores(query, keep)
        return scores.join(F.broadcast(ranked(scores, self.key, F.col("score"), k).select(self.key, "rank")), self.key)  # k rows

    def expanded(self, query: list[str], feedback: int = 10, terms: int = 10, share: float = 0.5) -> dict[str, float]:
        """The query with weighted terms of its best documents (relevance feedback in the manner of RM3).

        Of the ``feedback`` best documents each term's mean of tf / n, weighted by the documents' shares of their scores,
        is its weight; the ``terms`` heaviest ones, made to add up to 1, count ``share``, the query's own, equal ones, the rest.
        """
        own = dict.fromkeys(query, 1.0)
        best = self.scores(own).orderBy(F.desc("score"), self.key).limit(feedback)
        _, state = self._state()
        if not state["segments"]:
            return {t: 1.0 / len(own) for t in own}
        total = best.agg(F.sum("score").alias("total"))  # one row
        found = self._postings(state).filter("term <> ''").join(F.broadcast(best), self.key).crossJoin(F.broadcast(total))
        weights = found.groupBy("term").agg(F.round(F.sum(F.col("tf") / F.col("n") * F.col("score") / F.col("total")), 9).alias("w"))
        heavy = weights.orderBy(F.desc("w"), "term").limit(terms).collect()
        every = sum(r.w for r in heavy)
        out = {t: (1 - share) / len(own) for t in own}
        for r in heavy:
            out[r.term] = out.get(r.term, 0.0) + share * r.w / every
        return out
