"""Objective-C outlines: directives, method and C-like declarations at brace depth zero.

Depth never goes below zero. An outline is one fold over the lines of its text, whose state is the depth and
the lines shown so far, at most as many as the larger limit. For a table of lines, the floored running sum equals
the plain running sum minus its lowest value so far (when negative), so two windows give it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusfold.functions import langs, text
from corpusfold.operators import lines as L

SKELETON_LINES, MAP_LINES, LINE_CHARS = 180, 120, 240


def brace_delta(line: Column) -> Column:
    opened = F.length(line) - F.length(F.replace(line, F.lit("{"), F.lit("")))
    closed = F.length(line) - F.length(F.replace(line, F.lit("}"), F.lit("")))
    return opened - closed


def _kept(line: Column) -> Column:
    directive = text.starts_with_any(line, langs.OBJC_DIRECTIVES)
    method = text.starts_with_any(line, ("- ", "+ ", "-(", "+(")) & F.contains(line, F.lit(")"))
    breaks = "<:" + text.WHITESPACE
    word = F.substring_index(F.translate(line, breaks, " " * len(breaks)), " ", 1)
    shape = word.isin(*langs.OBJC_SHAPE_WORDS) & (
        F.contains(line, F.lit("(")) | F.endswith(line, F.lit(";")) | F.endswith(line, F.lit("{"))
    )
    return directive | method | shape


def _outline(line: Column) -> Column:
    head = text.trim_end(F.substring_index(line, "{", 1))
    cut = F.when(head == "", F.lit("{ ... }")).otherwise(F.concat(head, F.lit(" { ... }")))
    return text.truncate_chars(F.when(F.contains(line, F.lit("{")), cut).otherwise(line), LINE_CHARS)


def with_depth(lines: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``depth``: the brace depth in front of every line, floored at zero."""
    by = L.in_order(key)
    so_far = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        lines.withColumn("_sum", F.sum(brace_delta(F.col("line"))).over(so_far))
        .withColumn("_after", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(so_far)))
        .withColumn("depth", F.coalesce(F.lag("_after").over(by), F.lit(0)))
        .drop("_sum", "_after")
    )


def _shown(content: Column) -> Column:
    """The outlined lines at depth zero, repeats included, up to the larger limit: one fold over the lines of a text."""
    items = F.filter(
        F.transform(text.lines(content), text.trim), lambda line: (line != "") & ~text.starts_with_any(line, ("//", "/*", "*"))
    )

    def fold(acc: Column, line: Column) -> Column:
        # most lines have no brace, and only lines at depth zero are looked at further
        braces = F.contains(line, F.lit("{")) | F.contains(line, F.lit("}"))
        after = F.when(braces, F.greatest(F.lit(0), acc["depth"] + brace_delta(line))).otherwise(acc["depth"])
        kept = F.struct(
            after.alias("depth"), (acc["n"] + 1).alias("n"), F.concat(acc["shown"], F.lit("\n"), _outline(line)).alias("shown")
        )
        passed = F.struct(after.alias("depth"), acc["n"].alias("n"), acc["shown"].alias("shown"))
        full = acc["n"] >= max(SKELETON_LINES, MAP_LINES)
        return F.when(full, acc).when((acc["depth"] == 0) & _kept(line), kept).otherwise(passed)

    # the state is copied at every line, which costs less for one string than for an array of them
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit("").alias("shown"))
    return F.aggregate(items, start, fold, lambda acc: text.marked_lines(acc["shown"]))


def _variant(shown: Column, limit: int) -> Column:
    """The text of a rendering: the limit counts repeated lines, which are dropped afterwards."""
    unique = F.filter(F.slice(shown, 1, limit), lambda line, at: (at == 0) | (F.get(shown, at - 1) != line))
    imports = langs.IMPORT_PREFIXES["objc"]
    return text.join_lines(L.collapsed(unique, lambda line: text.starts_with_any(line, imports)))


def compress(files: DataFrame) -> DataFrame:
    """Adds skeleton and tree_map to files (path, content, ...), row by row: nothing is joined or moved."""
    outlines = text.let(
        F.coalesce(_shown(F.col("content")), F.array().cast("array<string>")),
        lambda shown: text.let(
            _variant(shown, SKELETON_LINES),
            # a short outline has one rendering
            lambda most: F.struct(
                most.alias("skeleton"), F.when(F.size(shown) <= MAP_LINES, most).otherwise(_variant(shown, MAP_LINES)).alias("tree_map")
            ),
        ),
    )
    outlined = files.withColumn("_o", outlines)
    return outlined.select(*files.columns, F.col("_o.skeleton").alias("skeleton"), F.col("_o.tree_map").alias("tree_map"))
