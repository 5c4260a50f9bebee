"""Streams with state, batch by batch, against one look at all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestone.sources.stored import Stored
from lodestone.streaming import state, sync
from lodestone.streaming.state import merged

START = dt.datetime(2024, 3, 1, tzinfo=dt.UTC)


def batches(spark, path, parts, schema):
    """A folder with one file a batch, read as a stream of one file a batch."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{k:03d}")
    return spark.readStream.schema(spark.read.parquet(f"{path}/in/000").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def test_spans():
    assert merged([(5, 9, 1), (0, 4, 2), (3, 6, 1), (9, 12, 1)]) == [(0, 9, 4), (9, 12, 1)]


def entries(puts, ttl):
    """Entries of one key that rows make in the order of their time: start, end, n."""
    out = []
    for t in sorted(puts):
        if out and t < out[-1][1]:
            out[-1] = (out[-1][0], t + ttl, out[-1][2] + 1)
        else:
            out.append((t, t + ttl, 1))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_entries_expire_over_batches(spark, tmp_path, seed):
    """Six batches; rows are up to 40 minutes late, the watermark allows an hour, so none is lost, whatever batch it is in."""
    rnd, ttl = random.Random(seed), 30
    puts = [(rnd.choice("abcde"), m) for m in sorted(rnd.randrange(24 * 60) for _ in range(160))]
    seen = sorted(puts, key=lambda p: p[1] + rnd.randrange(40))
    seen.append(("z", 40 * 60))  # ends the day for all the others
    parts = [[(k, START + dt.timedelta(minutes=m)) for k, m in seen[i * 27 : i * 27 + 27]] for i in range(6)]
    parts[2] += [(None, START), ("a", None)]
    stream = batches(spark, tmp_path, parts, "key string, ts timestamp")
    with state.store(spark):
        rows = sync.run_to_table(state.expired(stream, "key", "ts", ttl * 60, "1 hour"), spark, "expired").collect()
    want = [(k, *e) for k in "abcde" for e in entries([m for x, m in puts if x == k], ttl)]
    zero = START.replace(tzinfo=None)
    got = [(r.key, int((r.start - zero).total_seconds() // 60), int((r.end - zero).total_seconds() // 60), r.n) for r in rows]
    assert sorted(got) == sorted(want) and len(want) > 20 and any(n > 1 for *_, n in want)


def test_counters_know_a_batch_that_comes_again(spark, tmp_path):
    parts = [[("x", 1), ("x", 2), ("y", 1)], [("x", 1), (None, 1)], [("y", 1), ("y", 1)]]
    stream = batches(spark, tmp_path, parts, "kind string, who long")
    counts = Stored(spark, f"{tmp_path}/table", "id", buckets=4)
    want = {("x", 1): 2, ("x", 2): 1, ("y", 1): 3, (None, 1): 1}

    def held():
        return {(r.kind, r.who): r.n for r in counts.read().collect()}

    state.running_counts(stream, ["kind", "who"], counts, "c", f"{tmp_path}/state").awaitTermination()
    assert held() == want and counts.versions.last()[1]["batches"] == {"c": 2}
    version = counts.versions.last()[0]
    old = counts.read().withColumn("n", F.lit(0).cast("long"))
    assert counts.upsert(old, batch=("c", 2))["updated"] == 0  # the last batch, and an older one, once more
    assert counts.upsert(old, batch=("c", 0))["updated"] == 0
    assert held() == want and counts.versions.last()[0] == version
    state.running_counts(stream, ["kind", "who"], counts, "c", f"{tmp_path}/state").awaitTermination()  # nothing new
    assert held() == want


def test_a_stream_loads_each_row_once(spark, tmp_path):
    parts = [[(1, "a"), (2, "a"), (2, "b")], [(2, "c"), (3, "c")]]
    stream = batches(spark, tmp_path, parts, "k long, v string")
    table = Stored(spark, f"{tmp_path}/table", "k", buckets=4)
    for place in ("one", "two"):  # a lost checkpoint brings all batches again
        state.load(stream, table, place, f"{tmp_path}/{place}").awaitTermination()
        rows = {r.k: r.v for r in table.read().collect()}
        assert set(rows) == {1, 2, 3} and rows[1] == "a" and rows[2] in "ab" and rows[3] == "c"


def test_a_key_has_one_timer():
    """However many entries a key has, one timer is set, that of the first end; when it is early, or some entries are over, the next one is."""

    class Held:
        def __init__(self):
            self.timers, self.value = [], None

        def getValueState(self, *_):  # noqa: N802
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.now

    held, kept = Held(), state.Expiring(10)
    kept.init(held)
    assert list(kept.handleInputRows(("a",), iter([Row(at=t) for t in (50, 0, 20, 5)]), held)) == [] and held.timers == [15]
    list(kept.handleInputRows(("a",), iter([Row(at=12)]), held))  # 0 to 22 now, and with 20 to 30
    held.now = 15
    assert list(kept.handleExpiredTimer(("a",), held, None)) == [] and held.timers == [15, 30, 30]
    held.now = 35
    assert [(r.start, r.end, r.n) for r in kept.handleExpiredTimer(("a",), held, None)] == [(0, 30, 4)] and held.timers[-1] == 60
    held.now = 60
    assert [(r.start, r.end, r.n) for r in kept.handleExpiredTimer(("a",), held, None)] == [(50, 60, 1)] and held.value is None
