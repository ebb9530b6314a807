"""Three renderings of every file: full text, skeleton and tree map.

Files are split by syntax family. Web templates and configuration stay in JVM expressions; code needs
per-text state and goes through one Arrow UDF; Objective-C is a fold over lines, Markdown a window query over
lines. Each branch filters on the syntax family; a corpus laid out by it is read once in all.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusfold.functions import code_outline, langs, paths, text
from corpusfold.functions.tokens import Counter
from corpusfold.operators import lines as L
from corpusfold.operators import config, markdown, objc, web
from corpusfold.session import ship_package, stage

KIND = "kind"
_VARIANTS = ("skeleton", "tree_map")


_OUTLINES = T.StructType([T.StructField(name, T.StringType()) for name in _VARIANTS])

@F.pandas_udf(_OUTLINES)
def _code_outline(contents: pd.Series, syntaxes: pd.Series) -> pd.DataFrame:
    rows = [code_outline.outline(c, s) if c is not None else (None, None) for c, s in zip(contents, syntaxes)]
    return pd.DataFrame(rows, columns=list(_VARIANTS))


def _imports(outline: Column, syntax: Column) -> Column:
    """At least the number of lines that may belong to a run of imports or to a group of them.

    One expression over the whole outline for each family; splitting it into lines costs many times more.
    """
    blank = "[" + text.WHITESPACE + "]*"
    patterns = {
        family: f"(?m)^{blank}(?:{'|'.join(re.sub(r'[^\w]', r'\\\g<0>', prefix) for prefix in prefixes)})"
        for family, prefixes in langs.IMPORT_PREFIXES.items()
    }
    patterns["go"] = "(?m)^"  # lines inside a group have no mark of their own
    pattern = F.element_at(F.create_map(*[F.lit(v) for pair in patterns.items() for v in pair]), syntax)
    return F.regexp_count(outline, pattern)


def code(files: DataFrame) -> DataFrame:
    """Outlines of code. Only those with enough lines for a long import run go through the line operators."""
    ship_package(files.sparkSession)
    syntax = paths.syntax(F.col("path"))
    outlined = files.withColumn("_o", _code_outline(F.col("content"), syntax)).select(
        *files.columns, *[F.col(f"_o.{name}").alias(name) for name in _VARIANTS]
    )
    most = F.greatest(*[F.coalesce(_imports(F.col(name), syntax), F.lit(0)) for name in _VARIANTS])
    outlined = stage(outlined.withColumn("_many", most > langs.IMPORT_KEEP), "code-outlines")
    short, long = (outlined.filter(test).drop("_many") for test in (~F.col("_many"), F.col("_many")))
    texts = long.select(
        "path", syntax.alias("syntax"),
        F.explode(F.array(*[F.struct(F.lit(name).alias("which"), F.col(name).alias("text")) for name in _VARIANTS])).alias("v"),
    ).select("path", "syntax", "v.which", "v.text")
    key = ["path", "which"]
    collapsed = L.rejoin(L.collapse_imports(L.explode_lines(texts, key, "text", ("syntax",)), key), key)
    pairs = collapsed.groupBy("path").agg(*[F.max(F.when(F.col("which") == name, F.col("text"))).alias(f"_{name}") for name in _VARIANTS])

    def closed(name: str) -> Column:
        # lines lose the end of the last one; an outline without lines stays as it is
        ended = F.when(F.endswith(F.col(name), F.lit("\n")), F.concat(F.col(f"_{name}"), F.lit("\n"))).otherwise(F.col(f"_{name}"))
        return F.coalesce(ended, F.col(name)).alias(name)

    return short.unionByName(long.join(pairs, "path").select(*files.columns, *[closed(name) for name in _VARIANTS]))


def templates(files: DataFrame, counter: Counter) -> DataFrame:
    return files.withColumn("skeleton", web.outline(F.col("content"), counter, web.SKELETON_LINES)).withColumn(
        "tree_map", web.outline(F.col("content"), counter, web.MAP_LINES)
    )


def layout(files: DataFrame) -> DataFrame:
    """Stage a corpus partitioned by syntax family, so that each branch below reads only its own files."""
    if KIND in files.columns:
        return files
    return stage(files.withColumn(KIND, F.coalesce(paths.syntax(F.col("path")), F.lit("none"))), "corpus", partition_by=KIND)


def compress(files: DataFrame, counter: Counter) -> DataFrame:
    """Adds full, skeleton and tree_map to files (path, content, ...)."""
    family = F.col(KIND) if KIND in files.columns else paths.syntax(F.col("path"))
    columns = [name for name in files.columns if name != KIND]

    def of(*kinds: str) -> DataFrame:
        return files.filter(family.isin(*kinds)).select(*columns)

    branches = [
        code(of(*langs.CODE_SYNTAXES)),
        config.outline(of("config"), counter),
        templates(of("web"), counter),
        markdown.compress(of("markdown"), counter),
        objc.compress(of("objc")),
    ]
    result = branches[0]
    for branch in branches[1:]:
        result = result.unionByName(branch.select(*result.columns))
    # files of no family are an error, not a loss; without such files this branch is empty
    known = (*langs.CODE_SYNTAXES, "config", "web", "markdown", "objc")
    refuse = F.raise_error(F.concat(F.lit("no outline for this kind of file: "), F.col("path"))).cast("string")
    strange = files.filter(~F.coalesce(family.isin(*known), F.lit(False))).select(*columns, *[refuse.alias(name) for name in _VARIANTS])
    return result.unionByName(strange.select(*result.columns)).withColumn("full", F.col("content"))
