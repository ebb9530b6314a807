"""Change detection against a baseline: a snapshot table, a directory, or a change list.

Joins carry narrow rows only (path, size, time, digest); file contents are hashed before the
shuffle. No side is broadcast by hint: adaptive execution does that when the measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.functions import paths


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def against_snapshot(files: DataFrame, snapshot: DataFrame, key: str = "abs_path") -> DataFrame:
    """Added, changed or unchanged by key, then size and modification time."""
    base = snapshot.select(
        F.col(key), F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"), F.lit(True).alias("_hit")
    )
    same = (F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime"))
    return _classified(files.join(base, key, "left"), same)


def against_directory(files: DataFrame, base: DataFrame) -> DataFrame:
    """Added, changed or unchanged by relative path, then length, then content digest."""
    narrow = base.select(
        "path", F.col("size").alias("_size"), F.col("digest").alias("_digest"), F.lit(True).alias("_hit")
    )
    same = (F.col("size") == F.col("_size")) & (F.col("digest") == F.col("_digest"))
    return _classified(files.join(narrow, "path", "left"), same)


def _classified(joined: DataFrame, same: Column) -> DataFrame:
    delta = (
        F.when(F.col("_hit").isNull(), F.lit("added")).when(same, F.lit("unchanged")).otherwise(F.lit("changed"))
    )
    helpers = [name for name in joined.columns if name.startswith("_")]
    return joined.withColumn("delta", delta).drop(*helpers)


def against_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Delta from a change list; files it does not name are unchanged."""
    named = changes.select("path", F.col("delta").alias("_delta"))
    return (
        files.join(named, "path", "left")
        .withColumn("delta", F.coalesce("_delta", F.lit("unchanged")))
        .drop("_delta")
    )


def all_added(files: DataFrame) -> DataFrame:
    """What every file counts as when the baseline was taken under other selection options."""
    return files.withColumn("delta", F.lit("added"))


def with_inclusion(deltas: DataFrame, active: bool) -> DataFrame:
    """Unchanged files are left out once any incremental mode is on."""
    keep = F.col("delta") != "unchanged" if active else F.lit(True)
    return deltas.withColumn("included", keep)


def deleted(base: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    """Baseline keys without a counterpart."""
    return base.select(key).join(existing.select(key), key, "left_anti").distinct()


def touched(snapshot: DataFrame, seen: DataFrame, key: str = "abs_path") -> DataFrame:
    """Snapshot rows whose file was seen in this run."""
    return snapshot.join(seen.select(key), key, "left_semi")


def diagnostics(snapshot: DataFrame, listing: DataFrame, key: str = "abs_path") -> DataFrame:
    """Entries of a snapshot, and how many are missing or differ in size or time."""
    now = listing.select(
        key, F.col("size").alias("now_size"), F.col("mtime_ns").alias("now_mtime_ns"), F.lit(True).alias("now_file")
    )
    return health(snapshot.select(key, "size", "mtime_ns").join(now, key, "left"))


def health(probed: DataFrame) -> DataFrame:
    """Entries, and how many of them are stale, of entries next to what is there now."""
    fresh = F.col("now_file") & (F.col("size") == F.col("now_size")) & (F.col("mtime_ns") == F.col("now_mtime_ns"))
    return probed.agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(~F.coalesce(fresh, F.lit(False))).alias("stale_entries")
    )


def merge_changes(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """Union of both change sources; an untracked entry overrides a tracked one."""
    ordered = tracked.select("path", "delta", F.lit(0).alias("seq")).unionByName(
        untracked.select("path", F.lit("added").alias("delta"), F.lit(1).alias("seq"))
    )
    return ordered.groupBy("path").agg(F.max_by("delta", "seq").alias("delta"))


def changes_from_status(rows: DataFrame, include=(), exclude=()) -> tuple[DataFrame, DataFrame]:
    """Change list and deleted paths from decoded status rows (seq, status, old_path, path).

    Only extension and globs apply here, not ignore rules, size or the generated-file test.
    """

    def allowed(column: Column) -> Column:
        return paths.is_supported(column) & paths.passes_globs(column, include, exclude)

    kind = F.left("status", F.lit(1))
    events = rows.select(
        "seq",
        F.explode(
            F.array(
                F.struct(
                    F.when(kind == "R", paths.normalize(F.col("old_path"))).alias("path"),
                    F.lit("deleted").alias("event"),
                ),
                F.struct(
                    paths.normalize(F.col("path")).alias("path"),
                    F.when(kind == "D", F.lit("deleted"))
                    .when(kind.isin("A", "R", "C"), F.lit("added"))
                    .otherwise(F.lit("changed"))
                    .alias("event"),
                ),
            )
        ).alias("e"),
    ).select("seq", "e.*")
    events = events.filter(F.col("path").isNotNull() & allowed(F.col("path")))
    changed = (
        events.filter(F.col("event") != "deleted").groupBy("path").agg(F.max_by("event", "seq").alias("delta"))
    )
    gone = events.filter(F.col("event") == "deleted").select("path").distinct()
    return changed, gone
