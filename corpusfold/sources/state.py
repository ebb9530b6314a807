"""Snapshots: what earlier runs saw, with the renderings they computed, in a log keyed by path.

A run appends the files it compressed anew and marks those it no longer saw; the selection options it ran under are
part of the commit. A snapshot taken under other options is replaced as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.sources.keyed_log import KeyedLog

ENTRY_SCHEMA = (
    "abs_path string, size bigint, mtime_ns bigint, full string, skeleton string, tree_map string"
)
KEY = "abs_path"
# so many segments are merged on reading before they are written as one
MAX_SEGMENTS = 16


@dataclass
class Snapshot:
    """Entries with their renderings; ``seen`` has path, size and time alone, for joins that need no text."""

    entries: DataFrame
    selection: dict | None
    narrow: DataFrame | None = None

    def taken_under(self, selection: dict) -> bool:
        return self.selection == selection

    @property
    def seen(self) -> DataFrame:
        return self.narrow if self.narrow is not None else self.entries.select("abs_path", "size", "mtime_ns")


def log(spark: SparkSession, path: str) -> KeyedLog:
    return KeyedLog(spark, path, ENTRY_SCHEMA, KEY)


def is_snapshot(path: str) -> bool:
    """Whether a local folder is one of a snapshot."""
    return all((Path(path) / name).is_dir() for name in ("log", "segments"))


def load(spark: SparkSession, path: str) -> Snapshot:
    """The current snapshot; a missing or unreadable one counts as empty."""
    try:
        snapshot = load_required(spark, path)
        # reads the footer of every file, so that damage shows here and not in the middle of a run
        snapshot.seen.agg(F.count(F.lit(1))).collect()
        return snapshot
    except (PySparkException, Py4JError, ValueError):
        return Snapshot(spark.createDataFrame([], ENTRY_SCHEMA), None)


def load_required(spark: SparkSession, path: str) -> Snapshot:
    table = log(spark, path)
    live = table.commits()
    if not live or live[-1].meta is None:
        raise ValueError(f"no snapshot under {path}")
    return Snapshot(table.rows(), live[-1].meta, table.rows("size", "mtime_ns"))


def save(entries: DataFrame, path: str, selection: dict) -> None:
    """A snapshot of these entries alone; what it replaces is removed."""
    table = log(entries.sparkSession, path)
    table.append(entries, reset=True, meta=selection)
    table.vacuum()


def update(
    fresh: DataFrame, gone: DataFrame | None, path: str, selection: dict, batch: tuple[str, int] | None = None
) -> bool:
    """Add or replace entries and forget those of ``gone``; False where ``batch`` is in the snapshot already."""
    table = log(fresh.sparkSession, path)
    done = table.append(fresh, gone, meta=selection, batch=batch)
    if done and len(table.commits()) > MAX_SEGMENTS:
        table.compact()
        table.vacuum()
    return done is not None


def clear(spark: SparkSession, path: str) -> bool:
    """Forget the current snapshot and remove its files; returns whether there was one."""
    table = log(spark, path)
    cleared = table.clear()
    table.vacuum()
    return cleared


def read_through(files: DataFrame, snapshot: Snapshot) -> tuple[DataFrame, DataFrame]:
    """Files whose size and time match an entry, with its renderings, and all the others as they are.

    The decision joins narrow columns; contents take no part in a join of matched files.
    """
    same = ["abs_path", "size", "mtime_ns"]
    hits = files.drop("content").join(snapshot.entries.select(*same, "full", "skeleton", "tree_map"), same)
    return hits, files.join(snapshot.seen.select(*same), same, "left_anti")
