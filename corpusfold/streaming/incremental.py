"""The incremental mode over a stream of file rows.

Every micro-batch is one incremental run: its files are classified against the snapshot, only files
without a matching entry are compressed, and these alone are appended to the snapshot. All state lives in
its log, so a restarted query continues from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusfold.options import ContextOptions
from corpusfold.operators.select import select
from corpusfold.plans import context as plan
from corpusfold.session import stage
from corpusfold.sources import state


def latest(rows: DataFrame) -> DataFrame:
    """The newest row per file; a file may arrive more than once in a batch."""
    newest = rows.groupBy("abs_path").agg(F.max_by(F.struct(*rows.columns), "mtime_ns").alias("row"))
    return newest.select("row.*")


def run_batch(
    batch: DataFrame, options: ContextOptions, state_path: str, report: Callable[[DataFrame], None] = lambda deltas: None,
    number: tuple[str, int] | None = None,
) -> DataFrame:
    """One incremental step; returns (path, delta) of the batch and appends to the snapshot what it lacks.

    Changes are reported before the snapshot moves: a batch that fails in between is reported again when it
    is repeated, and no change is lost. A batch with a ``number`` (stream, epoch) is appended once, however often it runs.
    """
    spark = batch.sparkSession
    files = stage(latest(select(batch, options)), "batch")
    snapshot = state.load(spark, state_path)
    deltas = stage(
        plan.classify(files.drop("content"), options, plan.Baseline(snapshot=snapshot)).select("path", "delta"), "deltas"
    )
    report(deltas)
    variants = stage(plan.with_variants(files, options, snapshot), "variants")
    state.update(variants.where("fresh"), None, state_path, options.selection(), number)
    return deltas


def follow(
    stream: DataFrame,
    options: ContextOptions,
    state_path: str,
    checkpoint: str,
    on_batch: Callable[[DataFrame, int], None] = lambda deltas, epoch: None,
    **trigger,
) -> StreamingQuery:
    """Start the incremental mode on a stream of (path, abs_path, size, mtime_ns, content) rows."""

    def step(batch: DataFrame, epoch: int) -> None:
        run_batch(batch, options, state_path, lambda deltas: on_batch(deltas, epoch), (checkpoint, epoch))

    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
