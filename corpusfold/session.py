"""Session helpers: a local builder for tests, and tables staged in the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own_scratch: str | None = None
_shipped: dict[str, bool] = {}


def local_session(cores: str = "8", app: str = "corpusfold") -> SparkSession:
    """A local session for tests, the bench and the command line."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # whole files travel to the Arrow functions: bound a batch by bytes, not only by rows
        .config("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
        # plans here have thousands of expressions; capturing a call site for each one doubles the time to build them
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if _shipped.get(context.applicationId):
        return
    source = Path(__file__).resolve().parent
    # tasks may fetch the archive at any time, so it stays until the driver ends
    folder = tempfile.mkdtemp(prefix="corpusfold-package-")
    atexit.register(shutil.rmtree, folder, True)
    context.addPyFile(shutil.make_archive(f"{folder}/{source.name}", "zip", source.parent, source.name))
    _shipped[context.applicationId] = True


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without it: there the driver and the tasks share one machine.
    """
    global _own_scratch
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _own_scratch is None:
        _own_scratch = tempfile.mkdtemp(prefix="corpusfold-")
        atexit.register(shutil.rmtree, _own_scratch, True)
    return _own_scratch


def stage(df: DataFrame, name: str, *, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the scratch folder and read it back.

    This cuts lineage in a way that outlives executors, and, being columnar, lets later passes
    read only the narrow columns they need.
    """
    spark = df.sparkSession
    target = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(target)
    staged = spark.read.schema(df.schema).parquet(target)
    return staged.select(*df.columns)


def counted_stage(df: DataFrame, name: str, **numbers: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`stage`, with aggregates of the rows observed by the job that writes them; a sum over no rows is 0."""
    seen = Observation()
    staged = stage(df.observe(seen, *[value.alias(key) for key, value in numbers.items()]), name)
    return staged, {key: value or 0 for key, value in seen.get.items()}
