"""Streams that keep state of their own: entries that expire, counters that survive a batch run twice."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from lodestone.sources.stored import Stored

#: Where Spark keeps the state of processors with timers.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (start, end, n) that meet made one, in order."""
    out: list[tuple[int, int, int]] = []
    for start, end, n in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), out[-1][2] + n)
        else:
            out.append((start, end, n))
    return out


class Expiring(StatefulProcessor):
    """Entries of a key live ``ttl`` milliseconds after the last time they were put; what expires is given out.

    An entry that is put again before its end lives on; one put after it is another entry.  Rows may come late, in any
    order, as long as the watermark hasn't passed them: the entries are those that the rows make in the order of their time.
    A key has one timer, for the first of its entries that ends: each timer costs calls to the state store and a look at all of the
    key's entries.  One that is early, because its entry was put again, finds nothing over and sets the next one.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.spans = handle, handle.getValueState("spans", "starts array<long>, ends array<long>, counts array<long>")

    def _held(self) -> list[tuple[int, int, int]]:
        return list(zip(*self.spans.get(), strict=True)) if self.spans.exists() else []

    def _keep(self, spans: list[tuple[int, int, int]]) -> None:
        if spans:
            self.spans.update(tuple([*map(int, x)] for x in zip(*spans, strict=True)))
            self.handle.registerTimer(spans[0][1])  # spans don't meet, so the first one ends first
        else:
            self.spans.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        self._keep(merged([*self._held(), *((r.at, r.at + self.ttl, 1) for r in rows)]))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        over, spans = timerValues.getCurrentWatermarkInMs(), self._held()
        self._keep([s for s in spans if s[1] > over])
        for start, end, n in spans:
            if end <= over:
                yield Row(key=key[0], start=start, end=end, n=n)

    def close(self) -> None:
        pass


def expired(stream: DataFrame, key: str, time: str, ttl_seconds: int, late: str) -> DataFrame:
    """key (as text), start, end and n (how often it was put) of the entries of ``stream`` that have expired.

    ``time`` is when a row put its key's entry; rows without a time or key are left out.  An entry is given out when the
    watermark, ``late`` behind the latest row, has passed its end.  The stream starts inside store().
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(time).alias("time")).filter("key IS NOT NULL AND time IS NOT NULL")
    rows = rows.withColumn("at", F.unix_millis("time")).withWatermark("time", late)
    out = rows.groupBy("key").transformWithState(Expiring(ttl_seconds * 1000), "key string, start long, end long, n long", "Append", "EventTime")
    return out.select("key", F.timestamp_millis("start").alias("start"), F.timestamp_millis("end").alias("end"), "n")


def load(stream: DataFrame, table: Stored, name: str, checkpoint: str, how: str = "insert") -> StreamingQuery:
    """Insert or upsert each batch of a stream into a stored table, in which only the batch's buckets are read and written.

    A batch that runs again after a failure has its number in the table already and changes nothing; should its rows
    come in another batch, insert() finds their keys.
    """

    def one(batch: DataFrame, number: int) -> None:
        getattr(table, how)(batch, batch=(name, number))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(stream: DataFrame, keys: list[str], table: Stored, name: str, checkpoint: str) -> StreamingQuery:
    """Counts of the stream's rows by keys, kept in ``table`` (its key is the column id: the keys' hash as text, with n beside them).

    The stream is in update mode: a batch carries the counts that changed, as they are now, so putting one twice is no
    harm, and an older batch that comes again is known by its number.
    """
    parts = [F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in keys]
    counts = stream.groupBy(*keys).agg(F.count("*").alias("n")).select(F.sha2(F.concat(*parts), 256).alias("id"), *keys, "n")

    def one(batch: DataFrame, number: int) -> None:
        table.upsert(batch, batch=(name, number))

    return counts.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def store(spark: SparkSession) -> Iterator[None]:
    """The state store of STORE for streams that start inside; the session has its own one again afterwards."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
