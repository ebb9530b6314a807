"""One file written by many tasks, each at its own places."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.operators.prefix import running_totals
from corpusfold.session import ship_package


def write_single(rows: DataFrame, order: Column, text: Column, target: str) -> int:
    """The texts one after the other in one file; returns its bytes. Every task must reach ``target``.

    Places are running totals of byte lengths along ``order``, a unique key. A task that runs twice writes the same bytes
    at the same places, and the file has its name only once it is whole.
    """
    ship_package(rows.sparkSession)
    target = os.path.abspath(target)
    partial = f"{target}.partial"
    placed = running_totals(rows.select(order.alias("_order"), text.alias("_text")), F.col("_order"), {"_through": F.octet_length("_text").cast("long")})
    total = placed.agg(F.coalesce(F.max("_through"), F.lit(0)).alias("n")).first().n
    with open(partial, "wb") as out:
        out.truncate(total)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        with open(partial, "r+b") as out:
            for batch in batches:
                for piece, through in zip(batch.column(0), batch.column(1).to_pylist()):
                    data = piece.as_py().encode()
                    out.seek(through - len(data))
                    out.write(data)
                    written += len(data)
            out.flush()
            os.fsync(out.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["written"])

    done = placed.select("_text", "_through").mapInArrow(put, "written bigint").agg(F.sum("written").alias("n")).first().n or 0
    if done != total:
        raise RuntimeError(f"{done} of {total} bytes were written to {partial}")
    os.replace(partial, target)
    return total
