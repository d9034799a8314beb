"""Appending events to the log, and result tables with them, in commits.

A store is a folder on a file system that all executors share:

    commits/<number>.json   one small record per commit, created exclusively: the number decides who comes first
    keys/<hash>             one marker per key, written after its commit
    data/<attempt>/events   the events of an attempt, with the ids reserved for it
    data/<attempt>/<table>  result tables of the same commit

An attempt becomes visible by its commit record alone, so events and results appear together or not at all. A key that is committed is never
appended again. Ids follow the newest of the store, or of the log that it continues; two writers never share ids: the second to create a record
with the same number finds it there, and tries again with later ids. What a lost attempt wrote stays unread.

Exclusive creation is what the file system's ``create`` without overwriting gives (HDFS: atomic); object stores need a committer that has it. Records are read whole by the
driver, one line per commit; data is read by Spark.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.operators.ranking import with_position

EVENT = "id BIGINT, asset_id BIGINT, stage STRING, status STRING, message STRING"
RECORD = "number BIGINT, key STRING, attempt STRING, first_id BIGINT, last_id BIGINT, tables ARRAY<STRING>"
ATTEMPTS = 20


@dataclass(frozen=True)
class Commit:
    number: int
    key: str
    attempt: str
    first_id: int
    last_id: int
    tables: tuple[str, ...]
    fresh: bool = False

    @property
    def rows(self) -> int:
        return self.last_id - self.first_id + 1


class EventStore:
    """``log``: the events (id, asset_id, stage, status, message) that the store continues."""

    def __init__(self, spark: SparkSession, folder: str, log: DataFrame | None = None):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), log
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for name in ("commits", "keys"):
            self._fs.mkdirs(self._path(f"{self.folder}/{name}"))

    # --- records -----------------------------------------------------------------------------

    def _create(self, path: str, text: str) -> bool:
        """Writes a small file; False if it is there already. A local (or mounted) file system links a finished file into place, as its
        ``create`` would look first and write later."""
        local = self._fs.getUri().getScheme() == "file"
        target = self._path(path)
        written = self._path(target.getParent(), f".{uuid.uuid4().hex}") if local else target
        try:
            out = self._fs.create(written, False)
            out.write(bytearray(text.encode()))
            out.close()
            if local:
                file = self.spark._jvm.java.io.File
                self.spark._jvm.java.nio.file.Files.createLink(file(target.toUri().getPath()).toPath(), file(written.toUri().getPath()).toPath())
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        finally:
            if local:
                self._fs.delete(written, False)
        return True

    def _marker(self, key: str) -> str:
        return f"{self.folder}/keys/{hashlib.sha256(key.encode()).hexdigest()}"

    def _record(self, number: int) -> str:
        return f"{self.folder}/commits/{number:012d}.json"

    def _newest(self) -> int:
        """The number of the newest commit, 0 for none."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/commits"))]
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), default=0)

    def commits(self) -> list[Commit]:
        rows = self.spark.read.schema(RECORD).json(f"{self.folder}/commits").where("number IS NOT NULL").orderBy("number").collect() if self._newest() else []
        return [Commit(r.number, r.key, r.attempt, r.first_id, r.last_id, tuple(r.tables)) for r in rows]

    def committed(self, key: str) -> Commit | None:
        """The commit of a key. A record without its marker (the writer was lost between the two) counts, and gets the marker."""
        if self._fs.exists(self._path(self._marker(key))):
            return next(c for c in self.commits() if c.key == key)
        newest = self._newest()
        if newest:
            last = self.commits()[-1]
            self._create(self._marker(last.key), str(last.number))
            return last if last.key == key else None
        return None

    # --- writing -----------------------------------------------------------------------------

    def _last_id(self) -> int:
        done = self.commits()
        if done:
            return done[-1].last_id
        return 0 if self.log is None else int(self.log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])

    def append(self, key: str, events: DataFrame, order: tuple[str, ...], results: dict[str, DataFrame] | None = None) -> Commit:
        """Commits ``events`` (asset_id, stage, status, message and the columns of ``order``) and ``results`` under ``key``.

        Ids rise in the order of ``order``, which must be unique. A key that is committed is left as it is (``fresh`` is False).
        No events are a commit too: the key is done.
        """
        for _ in range(ATTEMPTS):
            done = self.committed(key)
            if done:
                return done
            number, first = self._newest() + 1, self._last_id() + 1
            attempt = uuid.uuid4().hex
            data = f"{self.folder}/data/{attempt}"
            placed = with_position(events, *order).withColumn("id", F.col("position") + F.lit(first - 1))
            placed.select("id", "asset_id", "stage", "status", "message").write.parquet(f"{data}/events")
            rows = self.spark.read.schema(EVENT).parquet(f"{data}/events").count()
            for table, df in (results or {}).items():
                df.write.parquet(f"{data}/{table}")
            record = {"number": number, "key": key, "attempt": attempt, "first_id": first, "last_id": first + rows - 1, "tables": sorted(results or {})}
            if self._create(self._record(number), json.dumps(record) + "\n"):
                self._create(self._marker(key), str(number))
                return Commit(**{**record, "tables": tuple(record["tables"])}, fresh=True)
        raise RuntimeError(f"{ATTEMPTS} other writers came first")

    # --- reading -----------------------------------------------------------------------------

    def appended(self, key: str | None = None) -> DataFrame:
        """The committed events, of one key or of all."""
        paths = [f"{self.folder}/data/{c.attempt}/events" for c in self.commits() if key in (None, c.key) and c.rows > 0]
        return self.spark.read.schema(EVENT).parquet(*paths) if paths else self.spark.createDataFrame([], EVENT)

    def events(self) -> DataFrame:
        """The whole log: what the store continues, and what has been committed to it."""
        new = self.appended()
        return new if self.log is None else self.log.select("id", "asset_id", "stage", "status", "message").unionByName(new)

    def result(self, key: str, table: str) -> DataFrame:
        commit = next(c for c in self.commits() if c.key == key)
        return self.spark.read.parquet(f"{self.folder}/data/{commit.attempt}/{table}")
