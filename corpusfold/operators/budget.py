"""Token budget: caps, the global downgrade sequence, fitting a formatted document, and dropping.

The greedy rule "downgrade the file with the greatest (score, tokens, path), repeat until the total
fits" is evaluated in closed form. Every file contributes at most two steps, 1->2 and 2->3. A later
step can only be taken after the earlier one, so its rank is the smaller of both keys. Sorting all
steps by that rank gives the greedy sequence, running totals give the state after every step, and
the first state within the budget is one key: a file applies exactly the steps ranked at or before
it. Levels are therefore computed per row from one scalar, with no join back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.functions import paths
from corpusfold.operators.prefix import running_totals

TREE_MAP = 3


def visible(level: Column, full: Column, skeleton: Column, tree_map: Column) -> Column:
    """What a file shows at its level; full text falls back to the skeleton when absent."""
    return F.when(level == 1, F.coalesce(full, skeleton)).when(level == 2, skeleton).otherwise(tree_map)


def checked_level(level: Column) -> Column:
    return F.when(level.isin(1, 2, 3), level).otherwise(F.raise_error(F.lit("level must be 1, 2, or 3")).cast("int"))


def at_level(level: Column, prefix: str = "t") -> Column:
    return F.when(level == 1, F.col(f"{prefix}1")).when(level == 2, F.col(f"{prefix}2")).otherwise(F.col(f"{prefix}3"))


def cap_level(level: Column, limit: int) -> Column:
    """First level at or below the start level whose tokens are within the per-file cap."""
    fits_1 = (level == 1) & (F.col("t1") <= limit)
    fits_2 = (level <= 2) & (F.col("t2") <= limit)
    return F.when(fits_1, F.lit(1)).when(fits_2, F.lit(2)).otherwise(F.lit(TREE_MAP))


def _rank(path: Column, tokens: Column, step: int) -> Column:
    return F.struct(
        paths.downgrade_score(path, tokens).alias("score"),
        tokens.alias("tokens"),
        path.alias("path"),
        F.lit(-step).alias("step"),
    )


def _step_ranks(path: Column, level: Column) -> tuple[Column, Column]:
    """Ranks of both steps of a file; null where the file starts past the step."""
    first = F.when(level == 1, _rank(path, F.col("t1"), 1))
    alone = _rank(path, F.col("t2"), 2)
    chained = F.when(
        F.struct(paths.downgrade_score(path, F.col("t1")), F.col("t1"))
        < F.struct(paths.downgrade_score(path, F.col("t2")), F.col("t2")),
        _rank(path, F.col("t1"), 2),
    ).otherwise(alone)
    return first, F.when(level == 1, chained).when(level == 2, alone)


def downgrade_steps(files: DataFrame, measures: dict[str, str]) -> DataFrame:
    """One narrow row per possible step; ``measures`` maps an output name to a column prefix."""
    first, second = _step_ranks(F.col("path"), F.col("level"))
    step_1 = F.struct(
        first.alias("rank"), *[(F.col(p + "1") - F.col(p + "2")).alias(name) for name, p in measures.items()]
    )
    step_2 = F.struct(
        second.alias("rank"), *[(F.col(p + "2") - F.col(p + "3")).alias(name) for name, p in measures.items()]
    )
    return (
        files.select(F.explode(F.array(step_1, step_2)).alias("s"))
        .select("s.*")
        .filter(F.col("rank").isNotNull())
    )


@dataclass(frozen=True)
class Cut:
    """Where a downgrade or drop sequence stops. ``rank`` is the last applied step, if any."""

    none: bool
    every: bool
    rank: object = None

    def applied(self, rank: Column) -> Column:
        if self.none:
            return F.lit(False)
        if self.every:
            return rank.isNotNull()
        return F.coalesce(rank >= _literal(self.rank), F.lit(False))


def _literal(row) -> Column:
    return F.struct(
        F.lit(row.score).cast("bigint").alias("score"),
        F.lit(row.tokens).cast("bigint").alias("tokens"),
        F.lit(row.path).alias("path"),
        F.lit(row.step).cast("int").alias("step"),
    )


def _total(files: DataFrame, value: Column) -> int:
    return files.agg(F.coalesce(F.sum(value), F.lit(0)).alias("v")).first().v


def apply_cut(files: DataFrame, cut: Cut) -> DataFrame:
    first, second = _step_ranks(F.col("path"), F.col("level"))
    taken = F.when(cut.applied(first), 1).otherwise(0) + F.when(cut.applied(second), 1).otherwise(0)
    return files.withColumn("level", (F.col("level") + taken).cast("int"))


def budget_cut(files: DataFrame, budget: int) -> Cut:
    """Stop of the downgrade sequence for the content budget; only scalars reach the driver."""
    return downgrade_cuts(files, budget)[0]


def downgrade_cuts(files: DataFrame, content_budget: int, document_budget: int | None = None, fixed: int = 0):
    """Stops of the content budget and, continuing the same sequence, of the formatted document.

    ``files`` has path, level, t1..t3 (content tokens) and, when a document budget is given, r1..r3
    (tokens of the rendered file including its map entry). ``fixed`` is what the rest of the document costs.
    Returns (content cut, document cut, whether the document fits).
    """
    measures = {"saved": "t"} if document_budget is None else {"saved": "t", "shrunk": "r"}
    sums = files.agg(
        F.coalesce(F.sum(at_level(F.col("level"))), F.lit(0)).alias("content"),
        *([F.coalesce(F.sum(at_level(F.col("level"), "r")), F.lit(0)).alias("rendered")] if document_budget is not None else []),
    ).first()
    needs_content = sums.content > content_budget
    if not needs_content and (document_budget is None or sums.rendered + fixed <= document_budget):
        cut = Cut(none=True, every=False)
        return cut, cut, True

    steps = running_totals(
        downgrade_steps(files, measures), F.col("rank").desc(), {name: F.col(name) for name in measures}
    )
    within = F.lit(sums.content) - F.col("saved") <= content_budget
    row = steps.agg(F.max(F.when(within, F.col("rank"))).alias("rank")).first()
    content_cut = (
        Cut(none=True, every=False) if not needs_content
        else Cut(none=False, every=row.rank is None, rank=row.rank)
    )
    if document_budget is None:
        return content_cut, content_cut, True

    fits = F.lit(sums.rendered + fixed) - F.col("shrunk") <= document_budget
    if content_cut.every:
        # every step is spent: the document fits only if the last state does
        return content_cut, content_cut, False
    reached = F.lit(True) if content_cut.none else F.col("rank") <= _literal(content_cut.rank)
    row = steps.agg(F.max(F.when(fits & reached, F.col("rank"))).alias("rank")).first()
    document_cut = Cut(none=False, every=row.rank is None, rank=row.rank)
    return content_cut, document_cut, row.rank is not None


def optimize(files: DataFrame, budget: int) -> DataFrame:
    """Downgrade levels until the content tokens fit the budget."""
    return apply_cut(files, budget_cut(files, budget))


def drop_rank(path: Column, tokens: Column) -> Column:
    """Greatest first: low priority, then many tokens, then late path."""
    return F.struct(
        (-paths.priority(path)).alias("score"), tokens.alias("tokens"), path.alias("path"), F.lit(0).alias("step")
    )


def drop_cut(files: DataFrame, limit: int, fixed: int = 0) -> Cut:
    """Stop of the drop sequence. ``files`` has path, tokens and cost; the last file always stays."""
    total = _total(files, F.col("cost"))
    if total + fixed <= limit:
        return Cut(none=True, every=False)
    ranked = running_totals(
        files.select(drop_rank(F.col("path"), F.col("tokens")).alias("rank"), "cost"),
        F.col("rank").desc(),
        {"freed": F.col("cost")},
    )
    survivor = F.min("rank")
    row = ranked.agg(
        F.max(F.when(F.lit(total + fixed) - F.col("freed") <= limit, F.col("rank"))).alias("rank"),
        survivor.alias("last"),
    ).first()
    if row.last is None:
        return Cut(none=True, every=False)
    if row.rank is None or row.rank == row.last:
        # nothing short of everything would do: drop all but the last-ranked file
        row_2 = ranked.filter(F.col("rank") > _literal(row.last)).agg(F.min("rank").alias("rank")).first()
        return Cut(none=row_2.rank is None, every=False, rank=row_2.rank)
    return Cut(none=False, every=False, rank=row.rank)


def drop_low_priority(files: DataFrame, limit: int, fixed: int = 0) -> DataFrame:
    cut = drop_cut(files, limit, fixed)
    return files.filter(~cut.applied(drop_rank(F.col("path"), F.col("tokens"))))
