"""Markdown skeletons and tree maps.

The skeleton keeps headings with up to two summary lines, sampled tables and lists, links and known
code fences. Its state (open fence, lines since a heading, table or list runs) is positional, so it
is computed with windows over the line table instead of a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusfold.functions import langs, text
from corpusfold.functions.tokens import Counter
from corpusfold.operators import lines as L

SKELETON_LINES, SKELETON_FALLBACK = 180, 120
MAP_HEADINGS, MAP_FALLBACK = 120, 80
FENCE_LINES = 24
SUMMARY_CHARS, LIST_CHARS, SUMMARY_LINES = 280, 240, 2


def _is_fence(bare: Column) -> Column:
    return F.startswith(bare, F.lit("```")) | F.startswith(bare, F.lit("~~~"))


def _fence_known(bare: Column) -> Column:
    word = F.regexp_extract(F.regexp_replace(bare, "^(?:```)*(?:~~~)*", ""), r"^[\s]*([^\s]*)", 1)
    return F.lower(word).isin(*langs.FENCE_LANGUAGES)


def _line_class(bare: Column) -> Column:
    """Class of a line outside fences."""
    pipes = F.length(bare) - F.length(F.replace(bare, F.lit("|"), F.lit("")))
    noise = (
        (bare == "")
        | F.contains(bare, F.lit("img.shields.io"))
        | F.contains(bare, F.lit("<img "))
        | F.startswith(bare, F.lit("<p align="))
    )
    table = F.startswith(bare, F.lit("|")) & F.endswith(bare, F.lit("|")) & (pipes >= 2)
    item = (
        (F.startswith(bare, F.lit("- ")) | F.startswith(bare, F.lit("* ")))
        & ~F.contains(bare, F.lit("badge"))
        & (F.char_length(bare) <= LIST_CHARS)
    )
    return (
        F.when(noise, "noise")
        .when(table, "table")
        .when(F.startswith(bare, F.lit("#")), "heading")
        .when(item, "item")
        .otherwise("prose")
    )


def _has_link(bare: Column) -> Column:
    inline = F.contains(bare, F.lit("](")) & F.contains(bare, F.lit("["))
    reference = F.startswith(bare, F.lit("[")) & F.contains(bare, F.lit("]:"))
    return inline | reference


def skeleton_lines(files: DataFrame, counter: Counter, key: str = "path", content: str = "content") -> DataFrame:
    """Rows (key, ord, line) of every skeleton, already deduplicated and limited."""
    by = L.in_order([key])
    so_far = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    t = L.explode_lines(files, [key], content, trimmed=True).withColumn("fence", _is_fence(F.col("line")))
    t = t.withColumn("open", F.count_if("fence").over(so_far) % 2 == 1)
    # a marker that makes the count odd opens a fence, the next marker closes it whatever it says
    opener = F.struct("pos", _fence_known(F.col("line")).alias("known"))
    t = t.withColumn("opener", L.since_last(by, F.col("fence") & F.col("open"), opener))
    t = t.withColumn(
        "kind",
        F.when(F.col("fence"), F.when(F.col("open"), "fence_open").otherwise("fence_close"))
        .when(F.col("open"), F.when(F.col("opener.known"), "fence_body").otherwise("hidden"))
        .otherwise(_line_class(F.col("line"))),
    )

    # up to two short prose lines after a heading count as its summary; a list item ends the search
    short = (F.col("kind") == "prose") & (F.char_length("line") <= SUMMARY_CHARS)
    t = t.select("*", F.count_if(short).over(so_far).alias("shorts"), F.lag("kind").over(by).alias("before"))
    in_run = F.col("kind").isin("table", "item")
    breaks = ~in_run | ~F.col("kind").eqNullSafe(F.col("before"))
    t = t.select(
        "*",
        L.since_last(by, F.col("kind").isin("heading", "item"), F.struct("kind", "shorts")).alias("under"),
        L.since_last(by, breaks, F.col("pos")).alias("run"),
    )
    summary = short & (F.col("under.kind") == "heading") & (F.col("shorts") - F.col("under.shorts") <= SUMMARY_LINES)

    # runs of table lines or list items: four lines ahead tell whether a line is in the run's tail
    ahead = [F.coalesce(F.lead("run", n).over(by) == F.col("run"), F.lit(False)) for n in range(1, L.TAIL + 1)]
    t = t.withColumn("followers", sum((test.cast("int") for test in ahead), F.lit(0)))

    # decide first what a line becomes, so that texts are shortened once and only where they show
    body_nth = F.col("pos") - F.col("opener.pos")
    nth = F.col("pos") - F.col("run") + 1
    linked = (F.col("kind") == "prose") & _has_link(F.col("line"))
    action = (
        F.when(F.col("kind").isin("fence_open", "fence_close"), F.lit("as is"))
        .when(
            F.col("kind") == "fence_body",
            F.when(body_nth <= FENCE_LINES, F.lit("short")).when(body_nth == FENCE_LINES + 1, F.lit("...")),
        )
        .when(in_run, L.sampled(F.lit("short"), nth, nth + F.col("followers")))
        .when((F.col("kind") == "heading") | summary | linked, F.lit("short"))
    )
    unknown_open = (F.col("kind") == "fence_open") & ~F.col("opener.known")
    places = F.when(unknown_open, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    shown = (
        F.when((F.col("action") == "...") | (F.col("sub") == 1), F.lit("..."))
        .when(F.col("action") == "short", counter.truncate(F.col("line"), langs.LINE_TOKEN_LIMIT))
        .otherwise(F.col("line"))
    )
    emitted = (
        t.select(key, "pos", "line", action.alias("action"), places.alias("places"))
        .filter(F.col("action").isNotNull())
        .select(key, "pos", "line", "action", F.explode("places").alias("sub"))
        .select(key, (F.col("pos") * 2 + F.col("sub")).alias("ord"), shown.alias("line"))
    )
    unique = L.drop_repeats(emitted, [key], "ord")
    return (
        unique.withColumn("_nth", F.row_number().over(L.in_order([key], "ord")))
        .filter(F.col("_nth") <= SKELETON_LINES)
        .drop("_nth")
    )


def tree_map(content: Column, counter: Counter) -> Column:
    """Headings of a document, else its first lines (row-wise)."""
    items = text.lines(content)
    headings = F.filter(F.transform(items, text.trim), lambda line: F.startswith(line, F.lit("#")))
    shown = counter.truncate_all(F.slice(headings, 1, MAP_HEADINGS), langs.LINE_TOKEN_LIMIT)
    return text.join_lines(
        F.when(F.size(shown) > 0, shown).otherwise(L.first_lines(items, counter, MAP_FALLBACK))
    )


def compress(files: DataFrame, counter: Counter) -> DataFrame:
    """Adds skeleton and tree_map to files (path, content, ...)."""
    skeletons = L.rejoin(skeleton_lines(files, counter), ["path"], "ord", "_skeleton")
    fallback = text.join_lines(L.first_lines(text.lines(F.col("content")), counter, SKELETON_FALLBACK))
    return (
        files.join(skeletons, "path", "left")
        .withColumn("skeleton", F.coalesce(F.col("_skeleton"), fallback))
        .withColumn("tree_map", tree_map(F.col("content"), counter))
        .drop("_skeleton")
    )
