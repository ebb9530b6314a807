"""The tree below a folder as rows, level by level: each level is one job, and each folder is opened once.

A folder's row carries the ignore rules that hold in it, so no task looks at the folders above its own again. A
task lists the folders it was dealt and hands on rows as it meets them; what a level found is written before the next.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusfold.functions import langs
from corpusfold.session import ship_package, stage
from corpusfold.sources import ignore

RULES = "array<struct<kind:int,base:string,text:string>>"
_LEVEL = f"abs_path string, is_dir boolean, size bigint, mtime_ns bigint, rules {RULES}"
# the first kind with a verdict decides; within a kind the deepest file does
_FILES = {".cursorignore": 0, ".ignore": 1, ".gitignore": 2}
_EXCLUDE, _GLOBAL = 3, 4
_ROWS = 5000
Rules = list[dict]


def _read(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as handle:
            return handle.read()
    except OSError:
        return None


def rules_above(root: str, with_git: bool) -> Rules:
    """Rules that hold in ``root`` from outside of it: those of the folders above and those of git's own files."""
    places = [(_FILES[name], base, os.path.join(base, name)) for name in _FILES for base in ignore.above(root, name) if with_git]
    if with_git:
        top = ignore.top_of(root)
        places += [(_EXCLUDE, top, os.path.join(top, ".git", "info", "exclude")), (_GLOBAL, top, ignore.global_file())]
    found = [{"kind": kind, "base": base, "text": _read(path)} for kind, base, path in places]
    return [rule for rule in found if rule["text"]]


@lru_cache(maxsize=4096)
def _parsed(text: str):
    return ignore.parsed_lines(text.splitlines())


def is_ignored(rules: Rules, path: str, is_dir: bool) -> bool:
    """By rules in the order in which they decide."""
    for rule in rules:
        below = os.path.relpath(path, rule["base"])
        verdict = None
        for pattern, negated, dirs_only in _parsed(rule["text"]):
            if (is_dir or not dirs_only) and pattern.fullmatch(below):
                verdict = not negated
        if verdict is not None:
            return verdict
    return False


def _list(folder: str, rules: Rules, with_git: bool, everything: bool) -> Iterator[tuple]:
    try:
        entries = list(os.scandir(folder))
    except OSError:
        return
    if not everything:
        named = {entry.name for entry in entries}
        own = [
            {"kind": kind, "base": folder, "text": text}
            for name, kind in _FILES.items()
            if name in named and (with_git or kind != _FILES[".gitignore"]) and (text := _read(os.path.join(folder, name)))
        ]
        # deeper files go before those of the same kind from above
        rules = sorted(own + rules, key=lambda rule: rule["kind"])
    for entry in entries:
        is_dir = entry.is_dir(follow_symlinks=False)
        if entry.name == ".git" or (not is_dir and not entry.is_file(follow_symlinks=False)):
            continue
        if not is_dir and os.path.splitext(entry.name)[1][1:].lower() not in langs.EXTENSIONS:
            continue
        if not everything and is_ignored(rules, entry.path, is_dir):
            continue
        if is_dir:
            yield entry.path, True, None, None, rules
            continue
        try:
            seen = entry.stat(follow_symlinks=False)
        except OSError:
            continue
        yield entry.path, False, seen.st_size, seen.st_mtime_ns, None


def list_tree(spark: SparkSession, root: str, *, with_git: bool, everything: bool = False) -> DataFrame:
    """Supported files below ``root``: path, abs_path, size, mtime_ns. ``everything`` leaves no file out by ignore rules."""
    if not os.path.isdir(root):
        raise FileNotFoundError(f"cannot resolve target path {root}")
    root = os.path.realpath(root)
    with_git = with_git and ignore.in_work_tree(root)
    ship_package(spark)
    parts = 2 * spark.sparkContext.defaultParallelism
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("base", pa.string()), ("text", pa.string())]))
    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), kind]
    names = [part.split()[0] for part in _LEVEL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, k) for column, k in zip(zip(*rows), kinds)], names=names)

        held: list[tuple] = []
        for batch in batches:
            for folder, rules in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in _list(folder, rules or [], with_git, everything):
                    held.append(row)
                    if len(held) >= _ROWS:
                        yield out(held)
                        held = []
        if held:
            yield out(held)

    folders = spark.createDataFrame([(root, [] if everything else rules_above(root, with_git))], f"abs_path string, rules {RULES}")
    files, left = None, 1
    while left:
        seen = Observation()
        listed = folders.repartition(min(parts, left)).mapInArrow(run, _LEVEL).observe(seen, F.count_if("is_dir").alias("folders"))
        level = stage(listed, "listing")
        found = level.where("NOT is_dir").select("abs_path", "size", "mtime_ns")
        files = found if files is None else files.unionByName(found)
        left = seen.get["folders"]
        folders = level.where("is_dir").select("abs_path", "rules")
    inside = F.substring("abs_path", F.lit(len(root.rstrip("/")) + 2), F.length("abs_path"))
    return files.select(F.replace(inside, F.lit("\\"), F.lit("/")).alias("path"), "abs_path", "size", "mtime_ns")
