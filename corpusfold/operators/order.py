"""Sort modes of the file list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusfold.functions import paths

MODES = ("path", "tokens", "priority")


def keys(mode: str) -> list[Column]:
    if mode == "path":
        return [F.col("path").asc()]
    if mode == "tokens":
        return [F.col("tokens").desc(), F.col("path").asc()]
    if mode == "priority":
        return [paths.priority(F.col("path")).desc(), F.col("path").asc()]
    raise ValueError(f"unknown sort mode {mode}; use one of {', '.join(MODES)}")


def key(mode: str) -> Column:
    """The same order as one ascending key; ``scan`` is the order of the raw listing."""
    if mode == "scan":
        return F.split(F.col("path"), "/")
    first = {"path": None, "tokens": -F.col("tokens"), "priority": -paths.priority(F.col("path"))}[mode]
    return F.col("path") if first is None else F.struct(first.alias("first"), F.col("path").alias("path"))


def scan_keys() -> list[Column]:
    """Order of the raw file listing: component by component, so ``a/b`` precedes ``a-b``."""
    return [F.split(F.col("path"), "/").asc()]
