"""A table keyed by one column, kept as an append-only log of change segments.

    <path>/segments/segment=<id>/   rows of one change, bucketed and sorted by the key
    <path>/log/<number>.json        one file a commit: its segment, what it stands for, the buckets

A change writes only its own rows, marking removed keys, and then publishes them by creating the file of the next
number, which no second writer can create again. What is not published does not exist for readers. Reading takes the
latest row of every key. All segments have the same buckets and are read as one bucketed table, so neither the merge
nor a join on the key moves the log over the network, when it is not small enough to be sent around anyway.

Compaction writes the merged rows as a segment that stands for all before it; ``vacuum`` removes what no reader needs.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMIT_SCHEMA = "number bigint, segment string, rows bigint, reset boolean, buckets int, meta string, batches map<string,bigint>"
_REMOVED, _SEGMENT = "_removed", "segment"


class LogConflict(RuntimeError):
    """Another writer has published the number first."""


@dataclass(frozen=True)
class Commit:
    number: int
    segment: str | None
    rows: int
    reset: bool
    buckets: int
    meta: dict | None
    batches: dict[str, int] = field(default_factory=dict)


class KeyedLog:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), StructType.fromDDL(schema), key

    # --- commits

    def commits(self) -> list[Commit]:
        """Commits in force: the last one that stands for all before it, and those after it."""
        try:
            # JSON files are lines of their own; one that was never finished is no commit
            rows = self.spark.read.schema(COMMIT_SCHEMA).json(f"{self.path}/log").where("number IS NOT NULL").collect()
        except PySparkException:
            return []
        found = [
            Commit(r.number, r.segment, r.rows or 0, bool(r.reset), r.buckets, json.loads(r.meta) if r.meta else None, r.batches or {})
            for r in sorted(rows, key=lambda r: r.number)
        ]
        last = max((i for i, c in enumerate(found) if c.reset), default=0)
        return found[last:]

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _children(self, folder: str) -> list[str]:
        fs, target = self._fs(f"{self.path}/{folder}")
        return [status.getPath().getName() for status in fs.listStatus(target)] if fs.exists(target) else []

    def _next(self) -> int:
        """One above every number taken, finished or not."""
        return max((int(name.split(".")[0]) for name in self._children("log") if name.endswith(".json")), default=0) + 1

    def _publish(self, commit: Commit) -> None:
        line = json.dumps({**commit.__dict__, "meta": json.dumps(commit.meta) if commit.meta is not None else None}) + "\n"
        fs, target = self._fs(f"{self.path}/log/{commit.number:012d}.json")
        try:
            out = fs.create(target, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName() or fs.exists(target):
                raise LogConflict(f"another writer has published {commit.number} under {self.path}") from None
            raise
        try:
            out.write(bytearray(line.encode()))
        finally:
            out.close()

    # --- writing

    def _write(self, rows: DataFrame, buckets: int) -> tuple[str, int]:
        segment = uuid.uuid4().hex
        name = f"keyed_log_{segment}"
        seen = f"rows_{segment}"
        # one task a bucket, so one file; rows are counted by the job that writes them
        dealt = rows.repartition(buckets, self.key)
        counted = Observation(seen)
        dealt.observe(counted, F.count(F.lit(1)).alias("n")).write.format("parquet").bucketBy(buckets, self.key).sortBy(self.key).option(
            "path", f"{self.path}/segments/{_SEGMENT}={segment}"
        ).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return segment, counted.get["n"]

    def _shaped(self, rows: DataFrame, removed: bool) -> DataFrame:
        columns = [
            F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema
        ]
        return rows.select(*columns, F.lit(removed).alias(_REMOVED))

    def append(
        self, rows: DataFrame | None, removed: DataFrame | None = None, *, reset: bool = False, meta: dict | None = None,
        batch: tuple[str, int] | None = None, buckets: int | None = None, number: int | None = None,
    ) -> Commit | None:
        """Publish changed rows and removed keys; ``rows`` must have each key once.

        ``batch`` (stream, epoch) makes a repeated batch a change that is there already: None is returned. ``number``
        is the number to publish, by default the next one; LogConflict is raised where it is taken. ``meta`` of None
        keeps what the last commit says, unless this one stands for all before it.
        """
        live = self.commits()
        batches = dict(live[-1].batches) if live else {}
        if batch is not None:
            if batches.get(batch[0], -1) >= batch[1]:
                return None
            batches[batch[0]] = batch[1]
        number = self._next() if number is None else number
        if live and not reset:
            buckets, meta = live[-1].buckets, live[-1].meta if meta is None else meta
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        changes = [self._shaped(df, gone) for df, gone in ((rows, False), (removed, True)) if df is not None]
        segment, n = None, 0
        if changes:
            whole = changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1])
            segment, n = self._write(whole, buckets)
        commit = Commit(number, segment, n, reset, buckets, meta, batches)
        self._publish(commit)
        return commit

    def compact(self) -> Commit | None:
        """One segment for all; changes published meanwhile win, and this one raises LogConflict."""
        live = self.commits()
        if len([c for c in live if c.segment]) < 2:
            return None
        number = self._next()
        last = live[-1]
        segment, n = self._write(self._shaped(self._merged(live), False), last.buckets)
        commit = Commit(number, segment, n, True, last.buckets, last.meta, last.batches)
        self._publish(commit)
        return commit

    def clear(self) -> bool:
        """Forget all rows; returns whether there was anything."""
        live = self.commits()
        if not live or (live[-1].reset and live[-1].segment is None):
            return False
        self.append(None, reset=True)
        return True

    def vacuum(self) -> int:
        """Remove segments and commits that no commit in force needs; returns how many segments went.

        Not for a moment in which another writer is between writing its rows and publishing them.
        """
        live = self.commits()
        kept = {f"{_SEGMENT}={c.segment}" for c in live}
        gone = [name for name in self._children("segments") if name not in kept]
        for name in gone:
            fs, target = self._fs(f"{self.path}/segments/{name}")
            fs.delete(target, True)
        for name in self._children("log"):
            if live and name.endswith(".json") and int(name.split(".")[0]) < live[0].number:
                fs, target = self._fs(f"{self.path}/log/{name}")
                fs.delete(target, False)
        return len(gone)

    # --- reading

    def rows(self, *columns: str) -> DataFrame:
        """The latest row of every key, with only these columns read, the key among them."""
        return self._merged(self.commits(), *columns)

    def _merged(self, live: list[Commit], *columns: str) -> DataFrame:
        names = [f.name for f in self.schema if not columns or f.name in columns or f.name == self.key]
        segments = {c.segment: c.number for c in live if c.segment}
        if not segments:
            return self.spark.createDataFrame([], self.schema).select(*names)
        read = self._table(live[-1].buckets).where(F.col(_SEGMENT).isin(*segments))
        if len(segments) == 1:
            return read.where(~F.col(_REMOVED)).select(*names)
        numbers = F.create_map(*[F.lit(v) for pair in segments.items() for v in pair])
        row = F.struct(*names, _REMOVED)
        latest = read.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(row, F.element_at(numbers, F.col(_SEGMENT))).alias("row"))
        return latest.where(~F.col(f"row.{_REMOVED}")).select(
            *[F.col("_key").alias(n) if n == self.key else F.col(f"row.{n}").alias(n) for n in names]
        )

    def _table(self, buckets: int) -> DataFrame:
        """All segments as one table whose buckets Spark knows. The catalog entry is only needed until it is resolved."""
        name, conf = f"keyed_log_{uuid.uuid4().hex}", "spark.sql.hive.manageFilesourcePartitions"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        folder = f"{self.path}/segments".replace("\\", "\\\\").replace("'", "\\'")
        before = self.spark.conf.get(conf)
        self.spark.conf.set(conf, "false")
        try:
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}, {_REMOVED} boolean, {_SEGMENT} string) USING parquet PARTITIONED BY ({_SEGMENT}) "
                f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {buckets} BUCKETS LOCATION '{folder}'"
            )
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.spark.conf.set(conf, before)
