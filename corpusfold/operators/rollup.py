"""Aggregations: totals, rollups by directory and extension, distribution, deltas and savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.functions import paths
from corpusfold.operators.prefix import running_totals
from corpusfold.session import stage


def total_tokens(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"))


def directory_summaries(files: DataFrame) -> DataFrame:
    """Files and tokens per direct parent directory."""
    return files.groupBy(paths.directory(F.col("path")).alias("path")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("tokens").cast("bigint").alias("tokens")
    )


def tokens_by_extension(files: DataFrame) -> DataFrame:
    ext = paths.extension(F.col("path"))
    label = F.when(ext == "", F.lit("<noext>")).otherwise(F.concat(F.lit("."), ext))
    return files.groupBy(label.alias("ext")).agg(F.sum("tokens").cast("bigint").alias("tokens"))


def token_distribution(files: DataFrame) -> DataFrame:
    """Minimum, exact median, mean and maximum, from the number of files with each token count.

    The two middle places are found on running totals over the distinct counts, so no task holds them all.
    """
    counts = stage(files.where("tokens IS NOT NULL").groupBy("tokens").agg(F.count(F.lit(1)).alias("files")), "token-counts")
    total = counts.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n")).scalar()
    placed = running_totals(counts.withColumn("upto", F.col("files")), F.col("tokens"), {"upto": F.col("files")})
    low, high = [F.min(F.when(2 * F.col("upto") >= total + extra, F.col("tokens"))) for extra in (0, 1)]
    return placed.agg(
        F.coalesce(F.min("tokens"), F.lit(0)).cast("bigint").alias("min"),
        F.coalesce((low + high) / 2, F.lit(0.0)).alias("median"),
        F.coalesce(F.sum(F.col("tokens") * F.col("files")) / F.sum("files"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.max("tokens"), F.lit(0)).cast("bigint").alias("max"),
    )


def delta_numbers() -> dict[str, Column]:
    """Aggregates of classified files."""
    named = {name: F.count_if(F.col("delta") == name) for name in ("added", "changed", "unchanged")}
    return named | {"skipped": F.count_if(~F.col("included"))}


def delta_counts(deltas: DataFrame, deleted: DataFrame) -> DataFrame:
    counted = deltas.agg(*[value.alias(name) for name, value in delta_numbers().items()])
    gone = deleted.agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("deleted", gone.scalar())


def savings(raw_tokens, shrunk_tokens) -> list:
    """Columns raw_tokens, shrunk_tokens, tokens_saved, saving_percent."""
    saved = F.greatest(raw_tokens - shrunk_tokens, F.lit(0))
    return [
        raw_tokens.alias("raw_tokens"),
        shrunk_tokens.alias("shrunk_tokens"),
        saved.alias("tokens_saved"),
        F.when(raw_tokens == 0, F.lit(0.0)).otherwise(saved / raw_tokens * F.lit(100.0)).alias("saving_percent"),
    ]
