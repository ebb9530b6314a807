"""Repository scan: a listing of narrow rows, and contents for those rows that need them.

Spark's own file sources skip names that start with a dot or an underscore, which belong to a repository
(``.github``, ``__init__.py``). The root must be reachable by every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusfold.operators.select import select
from corpusfold.options import ContextOptions
from corpusfold.sources.content import fetch, spread
from corpusfold.sources.listing import list_tree

SCHEMA = "path string, abs_path string, size bigint, mtime_ns bigint, content string"


def scan(spark: SparkSession, root: str, options: ContextOptions, *, content: bool = True) -> DataFrame:
    """Selected files of a repository: path, abs_path, size, mtime_ns and, when asked for, content."""
    files = select(list_tree(spark, root, with_git=options.respect_gitignore), options)
    return fetch(spread(files)) if content else files


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Every supported file that exists, whatever the ignore rules say, without contents."""
    return list_tree(spark, root, with_git=False, everything=True)
