"""A kept index of vectors: cells around centres, found by k-means.

The centres are fitted on a bounded sample, every vector then goes to the cell
of the centre with the largest cosine.  A search looks into the cells nearest to
a query; an exact one goes on, with the k-th best cosine found so far, into each
cell that could hold a better one: with an angle t between query and centre and
a radius r of the cell (the largest angle in it), no cosine in it is above
cos(t - r).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.versions import Versions, new_folder, written

#: Rows that the centres are fitted on at most (the driver holds them), rounds of k-means, and cells at most.
SAMPLE, ROUNDS, CELLS = 20_000, 12, 1024
#: Vectors and queries that meet in one product.
VECTORS, QUERIES = 4096, 1024


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def centres(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means of unit vectors by cosine; a centre that loses its last vector stays where it was. The first k rows are the start."""
    out = x[:k].copy()
    for _ in range(rounds):
        cell = (x @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, cell, x)
        out = np.where((sums * sums).sum(1, keepdims=True) > 0, unit(sums), out)
    return out


class VectorIndex:
    """The index in ``path`` of vectors made by ``maker`` (any name for the model and its settings).

    Where the index in ``path`` is of another maker or of another number of components, it counts as empty and the next
    add() begins it anew.  Vectors that are null, or hold a null or a value that isn't finite, are left out.
    """

    def __init__(self, spark: SparkSession, path: str, maker: str, dim: int, key: str = "vec_id", vector: str = "embedding"):
        self.spark, self.path, self.maker, self.dim, self.key, self.vector = spark, path.rstrip("/"), maker, dim, key, vector
        self.versions = Versions(spark, path)

    def _state(self) -> tuple[int, dict]:
        number, state = self.versions.last()
        good = state and state["maker"] == self.maker and state["dim"] == self.dim
        return number, state if good else {"maker": self.maker, "dim": self.dim, "centres": None, "parts": []}

    def _usable(self, rows: DataFrame) -> DataFrame:
        x = F.col(self.vector).cast("array<double>")
        finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
        return rows.filter(finite & (F.size(x) == self.dim)).select(F.col(self.key).cast("long").alias("id"), x.alias("x"))

    def _rows(self, state: dict) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/data/{p}") for p in state["parts"]]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "id long, x array<double>, cell int, near double")

    def _centres(self, state: dict) -> np.ndarray:
        if not state["centres"]:
            return np.zeros((0, self.dim))
        rows = self.spark.read.parquet(f"{self.path}/data/{state['centres']}").toPandas().sort_values("cell")  # CELLS at most
        return np.array(rows["x"].tolist(), np.float64)

    def _fit(self, rows: DataFrame, cells: int | None) -> str:
        some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
        x = unit(np.array(some["x"].tolist(), np.float64).reshape(len(some), self.dim))
        found = centres(x, min(cells or max(1, int(np.sqrt(len(x)))), CELLS, len(x)))
        name = uuid.uuid4().hex
        self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(found)], "cell int, x array<double>").coalesce(1).write.parquet(f"{self.path}/data/{name}")
        return name

    def add(self, rows: DataFrame, cells: int | None = None) -> int:
        """Take in the vectors whose key isn't there (of those with one key the smallest); says how many.

        The first add() fits the centres: on the SAMPLE rows whose keys have the smallest hashes, as many centres as the
        root of that number (or ``cells``).  Later ones keep them; rebuild() fits anew.
        """
        number, state = self._state()
        fresh = self._usable(rows).groupBy("id").agg(F.min("x").alias("x"))
        if state["parts"]:
            fresh = fresh.join(self._rows(state).select("id"), "id", "left_anti")
        fresh = written(fresh, new_folder(self.spark, "vectors"))
        many = fresh.count()
        if not many:
            return 0
        state = state | {"centres": state["centres"] or self._fit(fresh, cells)}
        at = self._centres(state)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    score = unit(np.array(pdf["x"].tolist(), np.float64)) @ at.T
                    yield pdf.assign(cell=score.argmax(1).astype(np.int32), near=score.max(1))

        name = uuid.uuid4().hex
        dealt = fresh.mapInPandas(place, "id long, x array<double>, cell int, near double").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16)))
        dealt.sortWithinPartitions("cell").write.parquet(f"{self.path}/data/{name}")
        self.versions.commit(number + 1, state | {"parts": [*state["parts"], name]})
        return many

    def rebuild(self, cells: int | None = None) -> int:
        """Fit the centres anew on what is there and deal all vectors to them; until that is done, searches find the index as it was."""
        number, state = self._state()
        if not state["parts"]:
            return 0
        other = VectorIndex(self.spark, new_folder(self.spark, "rebuilt"), self.maker, self.dim, "id", "x")
        many = other.add(self._rows(state).select("id", "x"), cells)
        _, made = other._state()
        names = {n: uuid.uuid4().hex for n in [made["centres"], *made["parts"]]}
        for old, new in names.items():
            self.spark.read.parquet(f"{other.path}/data/{old}").write.parquet(f"{self.path}/data/{new}")
        self.versions.commit(number + 1, made | {"centres": names[made["centres"]], "parts": [names[p] for p in made["parts"]]})
        return many

    def clean(self) -> int:
        """Delete what the last state doesn't name; see Versions.clean()."""
        _, state = self._state()
        return self.versions.clean({state["centres"], *state["parts"]})

    def cells(self) -> DataFrame:
        """cell, n and least (the smallest cosine with the centre) of each cell that has vectors."""
        return self._rows(self._state()[1]).groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least"))

    def _asked(self, queries: DataFrame) -> DataFrame:
        """Query vectors by number: a row each, keys may repeat."""
        return written(self._usable(queries).withColumn("row", F.monotonically_increasing_id()), new_folder(self.spark, "queries"))

    def _meet(self, state: dict, visits: DataFrame, k: int, sizes: dict[int, int]) -> DataFrame:
        """row, query, id and score of the k best in each visited cell; ``visits`` has row, query, x and cell."""
        blocks = {c: -(-n // VECTORS) for c, n in sizes.items()}
        of = F.create_map(*[y for c, n in blocks.items() for y in (F.lit(c), F.lit(n))]) if blocks else F.create_map().cast("map<int,int>")  # CELLS entries at most
        vectors = self._rows(state).select("cell", F.pmod(F.xxhash64("id"), of[F.col("cell")]).cast("int").alias("block"), "id", "x")
        asked = visits.withColumn("block", F.explode(F.sequence(F.lit(0), of[F.col("cell")] - 1))).select("cell", "block", "row", "query", "x")

        def best(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(v) and len(q):
                ids, x = v["id"].to_numpy(), unit(np.array(v["x"].tolist(), np.float64))
                for a in range(0, len(q), QUERIES):
                    some = q.iloc[a : a + QUERIES]
                    score = np.round(unit(np.array(some["x"].tolist(), np.float64)) @ x.T, 6)
                    for row, own, s in zip(some["row"].to_numpy(), some["query"].to_numpy(), score, strict=True):
                        order = np.lexsort((ids, -s))
                        order = order[ids[order] != own][:k]
                        out.append(pd.DataFrame({"row": row, "query": own, "id": ids[order], "score": s[order]}))
            return pd.concat(out) if out else pd.DataFrame({"row": [], "query": [], "id": [], "score": []})

        return vectors.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInPandas(best, "row long, query long, id long, score double")

    def _visits(self, asked: DataFrame, at: np.ndarray, sizes: dict[int, tuple[int, float]], probes: int, beyond: bool) -> DataFrame:
        """row, query, x and the cells to look into: the ``probes`` nearest; with ``beyond``, of the others those that can hold a cosine of at least the row's kth."""
        held = np.array(sorted(sizes), np.int64)
        radius = np.arccos(np.clip([sizes[c][1] for c in held.tolist()], -1, 1))

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf) or not len(held):
                    continue
                x = unit(np.array(pdf["x"].tolist(), np.float64))
                score = x @ at[held].T
                order = np.argsort(-score, axis=1, kind="stable")
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(len(held))[None, :].repeat(len(x), 0), 1)
                wanted = rank < probes
                if beyond:
                    angle = np.arccos(np.clip(score, -1, 1)) - radius[None, :]
                    bound = np.cos(np.clip(angle, 0, np.pi)) + 2e-6  # cosines are rounded to six digits
                    bound[(x * x).sum(1) == 0] = 1.0
                    bound = np.maximum(bound, 0.0) if (radius >= np.pi / 2 - 1e-9).any() else bound  # vectors without a length score 0
                    wanted = ~wanted & (bound >= pdf["kth"].to_numpy()[:, None])
                row, cell = np.nonzero(wanted)
                yield pd.DataFrame({"row": pdf["row"].to_numpy()[row], "query": pdf["id"].to_numpy()[row], "x": pdf["x"].to_numpy()[row], "cell": held[cell].astype(np.int32)})

        return asked.mapInPandas(choose, "row long, query long, x array<double>, cell int")

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
        """query, rank, key and score (cosine to six digits) of the k best other vectors of each query, from its ``probes`` nearest cells.

        With ``exact`` from all cells that can hold one of them.  Ties go to the smaller key; repeated queries answer
        each for itself.  ``queries`` has the columns of the indexed rows.
        """
        _, state = self._state()
        sizes = {r.cell: (r.n, r.least) for r in self.cells().collect()}  # CELLS at most
        asked, at, counts = self._asked(queries), self._centres(state), {c: n for c, (n, _) in sizes.items()}
        found = self._meet(state, self._visits(asked, at, sizes, probes, False), k, counts)
        rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
        if exact:
            found = written(found, new_folder(self.spark, "near"))
            kth = found.withColumn("rank", rank).filter(F.col("rank") == k).select("row", F.col("score").alias("kth"))
            more = asked.join(kth, "row", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
            found = found.unionByName(self._meet(state, self._visits(more, at, sizes, probes, True), k, counts))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", F.col("id").alias(self.key), "score")
