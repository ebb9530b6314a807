"""What is on disk behind rows that name files: existence, digests and contents, asked for where rows need it.

All three take a table with ``abs_path`` and keep its columns. Tasks open the files themselves, so every task must
reach them; a file is looked at once for each row that names it.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusfold.operators.prefix import running_totals
from corpusfold.session import ship_package

TASK_BYTES = 64 << 20
_BATCH_BYTES = 16 << 20


def _with(rows: DataFrame, fields: str, look: Callable[[str], tuple], size: int) -> DataFrame:
    """``rows`` with what ``look`` finds for each path; batches go out once their last values hold ``_BATCH_BYTES``."""
    ship_package(rows.sparkSession)
    at, names = rows.columns.index("abs_path"), [f.split()[0] for f in fields.split(", ")]
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.split()[1]] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

        for batch in batches:
            start, found, held = 0, [], 0
            for n, path in enumerate(batch.column(at).to_pylist(), 1):
                found.append(look(path))
                held += size if size else len(found[-1][-1])
                if held >= _BATCH_BYTES:
                    yield out(batch.slice(start, n - start), found)
                    start, found, held = n, [], 0
            if found:
                yield out(batch.slice(start), found)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [fields])
    return rows.mapInArrow(run, schema)


def _stat(path: str) -> tuple:
    try:
        seen = os.stat(path)
    except OSError:
        return False, False, None, None
    return True, stat.S_ISREG(seen.st_mode), seen.st_size, seen.st_mtime_ns


def probe(keys: DataFrame) -> DataFrame:
    """Adds now_exists, now_file, now_size and now_mtime_ns as they are at this moment, wherever a path lies."""
    return _with(keys, "now_exists boolean, now_file boolean, now_size bigint, now_mtime_ns bigint", _stat, 32)


def _digest(path: str) -> tuple:
    try:
        with open(path, "rb") as handle:
            return (hashlib.file_digest(handle, "sha256").hexdigest(),)
    except OSError as error:
        raise RuntimeError(f"cannot read source file {path}: {error}") from error


def digests(rows: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Adds digest, the SHA-256 of the bytes of a file, which are read in pieces."""
    return _observed(_with(rows, "digest string", _digest, 64), seen)


def _observed(read: DataFrame, seen: Observation | None) -> DataFrame:
    """``seen`` observes what was read, once an action has run: files and bytes."""
    if seen is None:
        return read
    return read.observe(seen, F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def _text(path: str) -> tuple:
    try:
        with open(path, encoding="utf-8", newline="") as handle:
            return (handle.read(),)
    except (OSError, UnicodeDecodeError) as error:
        raise RuntimeError(f"cannot read source file {path}: {error}") from error


def fetch(rows: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Adds content, the whole text of a file; bytes that are no UTF-8 are an error that names the file."""
    return _observed(_with(rows, "content string", _text, 0), seen)


def spread(rows: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows dealt so that each partition names about ``task_bytes`` of files: consecutive paths up to that sum.

    A folder with most files is dealt over many partitions, and many small folders share one.
    """
    placed = running_totals(
        rows.withColumn("_path", F.col("abs_path")), F.col("_path"), {"_through": F.greatest(F.col("size"), F.lit(1024))}
    )
    total = placed.agg(F.max("_through")).first()[0] or 0
    parts = max(1, -(-total // task_bytes))
    part = F.least(F.floor((F.col("_through") - 1) / task_bytes), F.lit(parts - 1)).cast("int")
    return placed.withColumn("_part", part).repartitionById(parts, F.col("_part")).select(*rows.columns)
