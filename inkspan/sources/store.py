"""A store of tables that change together: a log of commits, and indexes kept beside it.

Data are Parquet folders that are written once and never changed.  A commit is one
numbered file of the log, which names the folders that it adds to and takes from the
tables, so a batch appears in all tables or in none; readers see the folders of the
commits they know.  Two writers that take the same number do not both get it: the
second works again on what the first has left.  Each commit of a stream holds its
identifier and batch number, so a replayed batch is known and changes nothing, and a
new stream, or an old one with a new checkpoint, only adds.

An index is kept as runs: sorted out by a hash of the key into parts of some
`KEYS_A_PART` keys, so that looking up the keys of a batch reads only their parts, of
each run, however large the store is.  `FAN` runs of one level are merged into one of
the next, so there are few runs, and a key is rewritten a few times only.

The folder of the log needs a file system in which a file is renamed at once and not
onto another one, as in HDFS.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEYS_A_PART, FAN = 100_000, 8
#: Parts that a look-up names one by one; a batch that needs more of a run reads the run.
MOST_PARTS = 10_000
#: Times that a batch is worked anew because another writer was first.
ATTEMPTS = 20


@dataclass
class Snapshot:
    """What is committed up to a version.  tables: folders by table; tops: the largest id; runs: (folder, bits, level, rows) by index; streams: the last batch of each."""

    version: int = -1
    tables: dict[str, list[str]] = field(default_factory=dict)
    tops: dict[str, int] = field(default_factory=dict)
    runs: dict[str, list[dict]] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)

    def after(self, entry: dict) -> Snapshot:
        gone = set(entry.get("drops", ()))
        tables = {t: [f for f in folders if f not in gone] for t, folders in self.tables.items()}
        runs = {i: [r for r in held if r["folder"] not in gone] for i, held in self.runs.items()}
        for t, folder in entry.get("adds", ()):
            tables.setdefault(t, []).append(folder)
        for i, run in entry.get("runs", ()):
            runs.setdefault(i, []).append(run)
        streams = self.streams | ({entry["stream"]: entry["batch"]} if "stream" in entry else {})
        return Snapshot(entry["version"], tables, self.tops | entry.get("tops", {}), runs, streams)


class Conflict(Exception):
    """Another writer has taken the version."""


class Store:
    """schemas: the columns of each table.  indexes: for each, its columns after key, and, as SQL, how rows of one key become one."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str | StructType], indexes: dict[str, tuple[str, list[str]]]):
        self.spark, self.path, self.schemas, self.indexes = spark, path, schemas, indexes
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    # The log

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._at(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str, replace: bool) -> None:
        """A file that appears whole; without replace, Conflict where there is one."""
        made = f"{self.path}/_log/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(made), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, int(replace))
        if replace:
            options[0] = kind.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self._at(path)).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(self._at(made)), self._fs.makeQualified(self._at(path)), options)
        except Exception as e:
            self._fs.delete(self._at(made), False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(path) from None
            raise

    def _entry(self, version: int) -> str:
        return f"{self.path}/_log/{version:020d}.json"

    def snapshot(self) -> Snapshot:
        """The latest state: the last whole one, and the commits after it."""
        log, whole = f"{self.path}/_log", f"{self.path}/_log/whole"
        now = Snapshot()
        if self._fs.exists(self._at(whole)):
            now = Snapshot(**json.loads(self._text(whole)))
        while self._fs.exists(self._at(self._entry(now.version + 1))):
            now = now.after(json.loads(self._text(self._entry(now.version + 1))))
        if now.version < 0 and not self._fs.exists(self._at(log)):
            self._fs.mkdirs(self._at(log))
        return now

    def commit(self, entry: dict) -> None:
        """Publish an entry as its version, or raise Conflict.  Every 16th commit also leaves the whole state, which saves readers the earlier ones."""
        self._put(self._entry(entry["version"]), json.dumps(entry), replace=False)
        if entry["version"] % 16 == 15:
            self._put(f"{self.path}/_log/whole", json.dumps(self.snapshot().__dict__), replace=True)

    # Tables

    def read(self, table: str, at: Snapshot | None = None) -> DataFrame:
        """The committed rows of a table."""
        folders = (at or self.snapshot()).tables.get(table, [])
        if not folders:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*[f"{self.path}/{f}" for f in folders])

    def _write(self, df: DataFrame, name: str, by: str | None = None) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(f"{self.path}/{folder}")
        return folder

    # Indexes

    def _schema(self, index: str) -> str:
        return f"key string, {self.indexes[index][0]}"

    def _run(self, rows: DataFrame, index: str, level: int, most: int) -> dict:
        """Write a run of at most `most` rows, one for each key."""
        bits = max(0, (max(most, 1) - 1) // KEYS_A_PART).bit_length()
        folder = self._write(rows.withColumn("part", _part(F.col("key"), bits)).repartition("part"), f"index-{index}", "part")
        return {"folder": folder, "bits": bits, "level": level, "rows": most}

    def _read_run(self, index: str, run: dict, parts: list[int] | None = None) -> DataFrame:
        at = f"{self.path}/{run['folder']}"
        paths = [at] if parts is None else [p for p in (f"{at}/part={k}" for k in parts) if self._fs.exists(self._at(p))]
        if not paths:
            return self.spark.createDataFrame([], self._schema(index))
        return self.spark.read.option("basePath", at).schema(f"{self._schema(index)}, part int").parquet(*paths).drop("part")

    def _combined(self, index: str, rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(*map(F.expr, self.indexes[index][1]))

    def lookup(self, index: str, keys: DataFrame, at: Snapshot) -> DataFrame:
        """The index's rows of the given keys (a stored table with key).  Reads the parts of the runs in which they can be."""
        found = self.spark.createDataFrame([], self._schema(index))
        for run in at.runs.get(index, []):
            parts = None
            if run["bits"]:
                wanted = keys.select(_part(F.col("key"), run["bits"]).alias("part")).distinct().limit(MOST_PARTS + 1).collect()
                parts = [r["part"] for r in wanted] if len(wanted) <= MOST_PARTS else None
            found = found.unionByName(self._read_run(index, run, parts))
        return self._combined(index, found.join(keys.select("key").distinct(), "key", "left_semi"))

    def _indexed(self, now: Snapshot, new: dict[str, tuple[DataFrame, int]]) -> tuple[list, list]:
        """(runs, drops): new rows of the indexes as runs, and merges of full levels.  new has a bound on the rows of each."""
        added, drops = [], []
        for index, (rows, most) in new.items():
            if not most:
                continue
            held = [*now.runs.get(index, []), self._run(rows, index, 0, most)]
            level = 0
            while len(full := [r for r in held if r["level"] == level]) >= FAN:
                rows = self.spark.createDataFrame([], self._schema(index))
                for r in full:
                    rows = rows.unionByName(self._read_run(index, r))
                merged = self._run(self._combined(index, rows), index, level + 1, sum(r["rows"] for r in full))
                held = [r for r in held if r["level"] != level] + [merged]
                level += 1
            known = [r["folder"] for r in now.runs.get(index, [])]
            kept = [r["folder"] for r in held]
            added += [(index, r) for r in held if r["folder"] not in known]
            drops += [f for f in known if f not in kept]
        return added, drops

    # Writing

    def transact(self, stream: str, batch: int, work: Callable[[Snapshot], tuple[dict[str, DataFrame], dict[str, tuple[DataFrame, int]], dict[str, int]]]) -> bool:
        """Add what work gives for the present state as one commit; False if this batch of the stream is committed already.

        work returns new rows by table, new rows by index with a bound on their
        number, and the largest id of each table.  It is called again if another
        writer commits first.
        """
        for _ in range(ATTEMPTS):
            now = self.snapshot()
            if now.streams.get(stream, -1) >= batch:
                return False
            tables, new, tops = work(now)
            adds = [(t, self._write(df, t)) for t, df in tables.items()]
            runs, drops = self._indexed(now, new)
            try:
                self.commit({"version": now.version + 1, "stream": stream, "batch": batch, "adds": adds, "runs": runs, "drops": drops, "tops": tops, "at": time.time()})
                return True
            except Conflict:
                continue  # what was written stays unseen until vacuum
        raise Conflict(f"{ATTEMPTS} times another writer was first")

    def replace(self, tables: dict[str, DataFrame], indexes: dict[str, DataFrame] | None = None) -> None:
        """New contents of whole tables, and of indexes, as one commit: for patches, deletes and compaction.  Conflict if another writer commits first."""
        now = self.snapshot()
        adds = [(t, self._write(df, t)) for t, df in tables.items()]
        runs = []
        for index, rows in (indexes or {}).items():
            combined = self._combined(index, rows)
            runs.append((index, self._run(combined, index, 1, combined.count())))
        drops = [f for t in tables for f in now.tables.get(t, [])] + [r["folder"] for i in indexes or {} for r in now.runs.get(i, [])]
        self.commit({"version": now.version + 1, "adds": adds, "runs": runs, "drops": drops, "at": time.time()})

    def compact(self, table: str) -> None:
        """One folder instead of one for each batch."""
        self.replace({table: self.read(table)})

    def vacuum(self, hours: float = 24) -> int:
        """Remove folders that no commit names and that are older than any running batch; how many."""
        now, gone = self.snapshot(), 0
        kept = {f for folders in now.tables.values() for f in folders} | {r["folder"] for held in now.runs.values() for r in held}
        for name in [*self.schemas, *[f"index-{i}" for i in self.indexes]]:
            top = self._at(f"{self.path}/{name}")
            for status in self._fs.listStatus(top) if self._fs.exists(top) else ():
                old = status.getModificationTime() < (time.time() - hours * 3600) * 1000
                if old and f"{name}/{status.getPath().getName()}" not in kept:
                    gone += self._fs.delete(status.getPath(), True)
        return gone


def _part(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("int") if bits else F.lit(0)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identifier that Spark gave a stream when it made its checkpoint folder."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
