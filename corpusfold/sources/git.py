"""Git change lists: the commands run on the driver and write to the scratch folder, where Spark reads their output."""

from __future__ import annotations

import os
import subprocess
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.operators import delta
from corpusfold.session import scratch_dir
from corpusfold.sources import nul_records


def _git(spark: SparkSession, root: str, *args: str) -> str:
    """Runs a command and puts its output, which may be long, into a file that all tasks reach; returns its path."""
    with tempfile.NamedTemporaryFile(delete=False) as out:
        done = subprocess.run(["git", "-C", root, *args], stdout=out, stderr=subprocess.PIPE, check=False)
    if done.returncode:
        os.unlink(out.name)
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.decode(errors='replace').strip()}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    target = path(f"{scratch_dir(spark)}/git-{uuid.uuid4().hex}.cells")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(True, path(f"file://{out.name}"), target)
    return target.toString()


def changes_since(
    spark: SparkSession, root: str, ref: str, include=(), exclude=(), respect_gitignore: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(path, delta) of tracked and untracked changes against ``ref``, and the deleted paths."""
    standard = ["--exclude-standard"] if respect_gitignore else []
    tracked = _git(spark, root, "diff", "--name-status", "-z", "--relative", ref, "--")
    untracked = _git(spark, root, "ls-files", "--others", "-z", *standard, "--")
    changed, gone = delta.changes_from_status(nul_records.read_records(spark, tracked), include, exclude)
    new_rows = nul_records.cells(spark, untracked).select(
        F.monotonically_increasing_id().alias("seq"), F.lit("A").alias("status"), F.lit(None).cast("string").alias("old_path"), F.col("value").alias("path")
    )
    new, _ = delta.changes_from_status(new_rows, include, exclude)
    return delta.merge_changes(changed, new.select("path", F.lit("added").alias("delta"))), gone
