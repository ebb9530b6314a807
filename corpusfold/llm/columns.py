"""Column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` mentions it.

    Without this, an expression named inside the function of ``transform`` or ``filter`` is evaluated
    again for every element.
    """
    return F.get(F.transform(F.array(value), use), 0)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, separators: str = SPACES) -> Column:
    """The maximal runs between separators; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_column: str, text_column: str) -> Column:
    """Tells rows apart: rows with the same id and the same text are the same document."""
    return F.xxhash64(F.col(id_column), F.col(text_column))
