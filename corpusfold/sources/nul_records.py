"""NUL-separated records of two or three fields, read by as many tasks as the file has splits.

A cell alone does not say whether it begins a record: that depends on all cells before it. But each cell moves a small
automaton (a status is expected, or two paths, or one), so a split moves it from each of its three states to another
one, and adds a number of records. These moves, three pairs of numbers a split, are chained in the order of the splits;
after that every split knows the state in which it begins and the number of its first record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.session import ship_package

STATUS, TWO_PATHS, ONE_PATH = range(3)
_MOVES = "file string, block bigint, state int, ends int, records bigint"
_CELLS = "record bigint, state int, status string, first string, second string"
# field names of a cell by what it is
_COLUMN = {STATUS: "status", TWO_PATHS: "first", ONE_PATH: "second"}


def cells(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty cells with their file and the split that holds them, in order within a split."""
    found = spark.read.option("lineSep", "\0").text(path)
    return found.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).where("value <> ''")


def _after(state: int, cell: str) -> int:
    if state == STATUS:
        return TWO_PATHS if cell[0] in "RC" else ONE_PATH
    return ONE_PATH if state == TWO_PATHS else STATUS


def _moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, list[list[int]]] = {}
    for batch in batches:
        for cell, *split in zip(*(column.to_pylist() for column in batch.columns)):
            for way in known.setdefault(tuple(split), [[s, 0] for s in range(3)]):
                way[1] += way[0] == STATUS
                way[0] = _after(way[0], cell)
    rows = [(*split, s, *way) for split, ways in known.items() for s, way in enumerate(ways)]
    if rows:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        names = [part.split()[0] for part in _MOVES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """seq, status, old_path, path of every record, numbered from 0 in the order of files and places.

    A record cut short at the end is an error. The driver holds three short rows a split.
    """
    ship_package(spark)
    found = cells(spark, path)
    begins: dict[tuple, tuple[int, int]] = {}
    state, records = STATUS, 0
    ways: dict[tuple, dict] = {}
    for row in found.mapInArrow(_moves, _MOVES).orderBy("file", "block").toLocalIterator():
        ways.setdefault((row.file, row.block), {})[row.state] = (row.ends, row.records)
    for split, by_state in ways.items():
        begins[split] = (state, records)
        state, more = by_state[state]
        records += more
    if state != STATUS:
        raise ValueError("invalid git diff --name-status output")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple, list[int]] = {}
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("record", "state", *_COLUMN.values())}
            for cell, *split in zip(*(column.to_pylist() for column in batch.columns)):
                here = at.setdefault(tuple(split), list(begins[tuple(split)]))
                here[1] += here[0] == STATUS
                out["record"].append(here[1] - 1)
                out["state"].append(here[0])
                for s, name in _COLUMN.items():
                    out[name].append(cell if s == here[0] else None)
                here[0] = _after(here[0], cell)
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    # the cells of a record meet; all but those of a record across a border are in one task already
    whole = found.mapInArrow(label, _CELLS).groupBy("record").agg(*[F.max(name).alias(name) for name in _COLUMN.values()])
    return whole.select(F.col("record").alias("seq"), "status", F.col("first").alias("old_path"), F.col("second").alias("path"))
