"""Line operators over an exploded line table.

Texts are hash-partitioned by file before they are exploded, so every window below runs on that one
shuffle; a window partition is the lines of one file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusfold.functions import langs, text
from corpusfold.functions.tokens import Counter

HEAD, TAIL = 10, 4


def explode_lines(
    df: DataFrame, key: list[str], content: str, keep: tuple[str, ...] = (), *, trimmed: bool = False, together: bool = True
) -> DataFrame:
    """Rows (key, keep, pos, line); a file without lines yields no row.

    Trimming happens in front of the explode: as a generator output the trimmed line is computed
    once, whereas a later filter would pull the trim into every one of its tests. ``together`` moves
    texts of one key to one task first; leave it off where a key spans an unbounded number of rows.
    """
    items = text.lines(F.col(content))
    if trimmed:
        items = F.transform(items, text.trim)
    rows = df.select(*key, *keep, content)
    if together:
        # a fixed partition count: exploded lines cost far more than the bytes that adaptive merging looks at
        rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    return rows.select(*key, *keep, F.posexplode(items).alias("pos", "line"))


def in_order(key: list[str], order: str = "pos"):
    return W.partitionBy(*key).orderBy(order)


def since_last(window, flag: Column, value: Column) -> Column:
    """``value`` at the latest row so far where ``flag`` holds."""
    return F.last(F.when(flag, value), ignorenulls=True).over(
        window.rowsBetween(W.unboundedPreceding, W.currentRow)
    )


def drop_repeats(df: DataFrame, key: list[str], order: str = "pos", line: str = "line") -> DataFrame:
    """Drop a line equal to the one right before it; later repeats stay."""
    before = F.lag(line).over(in_order(key, order))
    return df.withColumn("_before", before).filter(~F.col(line).eqNullSafe(F.col("_before"))).drop("_before")


def import_like(bare: Column, syntax: Column) -> Column:
    """Whether a trimmed line counts as an import in its syntax family."""
    test = F.lit(False)
    for family, prefixes in langs.IMPORT_PREFIXES.items():
        test = F.when(syntax == family, text.starts_with_any(bare, prefixes)).otherwise(test)
    return test


def collapse_runs(
    df: DataFrame, key: list[str], flag: Column, order: str = "pos", keep: int = langs.IMPORT_KEEP
) -> DataFrame:
    """Keep some lines of a longer run of flagged lines, then say how many more there were."""
    window = in_order(key, order)
    numbered = df.withColumn("_flag", flag).withColumn("_rn", F.row_number().over(window))
    anchored = numbered.withColumn("_anchor", F.coalesce(since_last(window, ~F.col("_flag"), F.col("_rn")), F.lit(0)))
    sized = anchored.withColumn("_run", F.count_if("_flag").over(W.partitionBy(*key, "_anchor"))).withColumn(
        "_nth", F.col("_rn") - F.col("_anchor")
    )
    note = F.concat(F.lit("... "), (F.col("_run") - keep).cast("string"), F.lit(" more imports"))
    return (
        sized.filter(~F.col("_flag") | (F.col("_nth") <= keep + 1))
        .withColumn("line", F.when(F.col("_flag") & (F.col("_nth") == keep + 1), note).otherwise(F.col("line")))
        .drop("_flag", "_rn", "_anchor", "_run", "_nth")
    )


def collapsed(items: Column, flag: Callable[[Column], Column], keep: int = langs.IMPORT_KEEP) -> Column:
    """:func:`collapse_runs` for the lines of one text in an array; meant for outlines, whose length is bounded."""

    def closed(acc: Column) -> Column:
        note = F.concat(F.lit("... "), (acc["run"] - keep).cast("string"), F.lit(" more imports"))
        return F.when(acc["run"] > keep, F.concat(acc["out"], F.array(note))).otherwise(acc["out"])

    def fold(acc: Column, line: Column) -> Column:
        run = F.when(acc["run"] < keep, F.concat(acc["out"], F.array(line))).otherwise(acc["out"])
        return F.when(flag(line), F.struct((acc["run"] + 1).alias("run"), run.alias("out"))).otherwise(
            F.struct(F.lit(0).alias("run"), F.concat(closed(acc), F.array(line)).alias("out"))
        )

    start = F.struct(F.lit(0).alias("run"), F.array().cast("array<string>").alias("out"))
    # most texts have no long run
    return text.let(
        items, lambda lines: F.when(F.size(F.filter(lines, flag)) <= keep, lines).otherwise(F.aggregate(lines, start, fold, closed))
    )


def collapse_import_groups(df: DataFrame, key: list[str], order: str = "pos", keep: int = langs.IMPORT_KEEP) -> DataFrame:
    """Parenthesised import groups: of more than ``keep`` entries that many stay, a count and the closing line.

    A closing line ends one stretch of lines; a stretch holds a group exactly when an opening line
    precedes its closing line, so both ends are plain aggregates per stretch.
    """
    window = in_order(key, order)
    bare = text.trim(F.col("line"))
    marked = df.withColumn("_bare", bare).withColumn(
        "_opens",
        (F.col("_bare") == "import (")
        & ~F.startswith(F.coalesce(F.lag(bare).over(window), F.lit("")), F.lit("import ")),
    ).withColumn("_closes", F.col("_bare") == ")")
    stretch = marked.withColumn(
        "_stretch",
        F.coalesce(F.count_if("_closes").over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    )
    whole = W.partitionBy(*key, "_stretch")
    grouped = stretch.withColumn("_open", F.min(F.when(F.col("_opens"), F.col(order))).over(whole)).withColumn(
        "_closed", F.max("_closes").over(whole)
    )
    grouped = grouped.withColumn(
        "_entry",
        F.coalesce(F.col("_closed") & (F.col(order) > F.col("_open")) & ~F.col("_closes"), F.lit(False)),
    ).withColumn("_named", F.col("_entry") & (F.col("_bare") != ""))
    counted = grouped.withColumn("_n", F.count_if("_named").over(whole)).withColumn(
        "_nth", F.count_if("_named").over(W.partitionBy(*key, "_stretch").orderBy(order))
    )
    long_group = F.col("_entry") & (F.col("_n") > keep)
    note = F.concat(F.lit("    ... "), (F.col("_n") - keep).cast("string"), F.lit(" more imports"))
    return (
        counted.filter(~long_group | (F.col("_named") & (F.col("_nth") <= keep + 1)))
        .withColumn("line", F.when(long_group & (F.col("_nth") == keep + 1), note).otherwise(F.col("line")))
        .withColumn("in_group", F.coalesce(F.col("_closed") & (F.col(order) >= F.col("_open")), F.lit(False)))
        .drop(*[c for c in counted.columns if c.startswith("_")])
    )


def collapse_imports(lines: DataFrame, key: list[str], order: str = "pos", keep: int = langs.IMPORT_KEEP) -> DataFrame:
    """Both import rules on a line table that carries a ``syntax`` column."""
    grouped = collapse_import_groups(lines.filter(F.col("syntax") == "go"), key, order, keep)
    plain = lines.filter(F.col("syntax") != "go").withColumn("in_group", F.lit(False))
    both = grouped.unionByName(plain).withColumn("_bare", text.trim(F.col("line")))
    flag = import_like(F.col("_bare"), F.col("syntax")) & ~F.col("in_group") & (F.col("_bare") != "import (")
    return collapse_runs(both, key, flag, order, keep).drop("in_group", "_bare")


def sample_runs(df: DataFrame, key: list[str], order: str = "pos", head: int = HEAD, tail: int = TAIL) -> DataFrame:
    """Head and tail of every key's lines: as many as both hold stay, else the head, an ellipsis and the tail.

    A key may hold any share of all lines. Both ends come from ranked windows with a small bound,
    which Spark applies before the shuffle, and the count is pre-aggregated; no task sees a whole key.
    """
    whole = head + tail
    first, last = F.row_number().over(in_order(key, order)), F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))
    begin = df.withColumn("_nth", first).filter(F.col("_nth") <= whole)
    end = df.withColumn("_back", last).filter(F.col("_back") <= tail)
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    end = end.join(sizes, key).withColumn("_nth", F.col("_n") - F.col("_back") + 1).filter(F.col("_nth") > whole)
    ends = begin.join(sizes, key).unionByName(end.drop("_back"))
    kept = ends.withColumn("line", sampled(F.col("line"), F.col("_nth"), F.col("_n"), head, tail)).filter(F.col("line").isNotNull())
    # a tail line that repeats the line shown before it is skipped
    previous = F.lag("line").over(in_order(key, order))
    in_tail = (F.col("_n") > whole) & (F.col("_nth") > F.col("_n") - tail)
    return (
        kept.withColumn("_skip", in_tail & F.coalesce(F.col("line") == previous, F.lit(False)))
        .filter(~F.col("_skip"))
        .drop("_nth", "_n", "_skip")
    )


def sampled(line: Column, nth: Column, n: Column, head: int = HEAD, tail: int = TAIL) -> Column:
    """What the sample shows at one position; null where nothing is shown.

    ``n`` may stop counting ``tail`` lines after the position: only the last ones need it exact.
    """
    return (
        F.when((n <= head + tail) | (nth <= head) | (nth > n - tail), line)
        .when(nth == head + 1, F.lit("..."))
    )


def rejoin(lines: DataFrame, key: list[str], order: str = "pos", name: str = "text") -> DataFrame:
    """Lines back to one text per key; a group is one file's own lines."""
    ordered = F.sort_array(F.collect_list(F.struct(order, "line")))
    return lines.groupBy(*key).agg(text.join_lines(ordered["line"]).alias(name))


def first_lines(items: Column, counter: Counter, n: int) -> Column:
    """First ``n`` non-empty trimmed lines, each within the line token limit (row-wise, no shuffle)."""
    bare = F.filter(F.transform(items, text.trim), lambda line: line != "")
    return counter.truncate_all(F.slice(bare, 1, n), langs.LINE_TOKEN_LIMIT)
