"""Folders of a session's own, and numbered states of what is kept in a folder."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own: in the session's ``spark.checkpoint.dir``, or on the machine itself where a local session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, path: str) -> DataFrame:
    """Write ``rows`` as a new Parquet table and return that: what reads it twice computes it once."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def seen(watch: Observation, *names: str) -> dict[str, int]:
    """What a finished job's observation counted; zeros where Spark knew beforehand that there were no rows, and left the step out."""
    try:
        got = watch.get
    except Py4JJavaError:
        got = {}
    return {n: got.get(n) or 0 for n in names}


class Versions:
    """The states of a table in ``folder``, each a small JSON file with a number; the largest number is the state.

    Data go to folders with names of their own and count only when a state names them.  So a job that dies before its
    commit leaves the state as it was, and readers of an older state go on reading its folders.  A commit is one rename
    that doesn't replace a file: of two writers that began from one state the second one is refused, where the file
    system keeps that promise (HDFS and local ones do).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, folder: str) -> list[str]:
        """What is in a folder of the table; none if there is no such folder."""
        at = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def last(self) -> tuple[int, dict]:
        """Number and state; 0 and an empty one where nothing was committed yet."""
        found = [x for x in self.names("states") if x.endswith(".json") and not x.startswith((".", "_"))]
        if not found:
            return 0, {}
        stream = self._fs.open(self._path(f"states/{found[-1]}"))
        try:
            return int(found[-1][:-5]), json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, state: dict) -> None:
        """Make ``state`` the one with this number; FileExistsError if another writer was first."""
        draft, final = self._path(f"states/_{uuid.uuid4().hex}"), self._path(f"states/{number:012d}.json")
        if self._fs.exists(final):
            raise FileExistsError(f"{self.folder}: state {number} is there already")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        no_options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), no_options)
        except Exception as e:
            if self._fs.exists(final):
                raise FileExistsError(f"{self.folder}: state {number} is there already") from e
            raise

    def clean(self, used: set[str], folder: str = "data") -> int:
        """Delete the folders of ``folder`` that aren't used; says how many. Readers of older states must be done, and no other writer at work."""
        gone = [x for x in self.names(folder) if x not in used]
        for x in gone:
            self._fs.delete(self._path(f"{folder}/{x}"), True)
        return len(gone)
