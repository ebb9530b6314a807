"""Mixing sources to target weights along a curriculum, with native functions only.

Every source has a weight schedule over training time 0 to 1, piecewise linear between knots. Its integral is the
weight of the source; all weights together share as many words as the table has. A target stops at ``max_epochs``
times the size of its source, and what is above is shared again by weight: in the order of cap by weight, sources are
capped until the common level of the rest stays below their caps.

A source hands out its documents in an order fixed by a digest of their ids, again from the front when it is through,
until its target is met; the last document is cut there. The words a source has handed out at some time are the
integral of its schedule up to then. Inverting it at the place of a document gives the time of the document, and
documents are sorted by time, range-partitioned.

Every sum along an order is a running total over a range partitioning, so a source with a third of all rows is
spread over tasks, and the numbers of sources and documents are free.

Defined results: a null text has no words; a null source is a source, the last; ids may repeat, rows with equal id are
told apart by size and text, and equal rows count each for itself; a table without words gives targets of 0 and takes
nothing; an empty table gives no rows. Other columns are not looked at. Reruns give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.operators.prefix import running_totals
from corpusfold.session import stage

Knots = tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class MixOptions:
    """Schedules go to the sources in order, again from the first; knots are (time, weight) from time 0 to time 1."""

    schedules: tuple[Knots, ...] = (
        ((0.0, 0.5), (1.0, 1.5)),
        ((0.0, 2.0), (1.0, 2.0)),
        ((0.0, 4.0), (0.5, 3.0), (1.0, 2.0)),
    )
    max_epochs: int = 3


def integrals(knots: Knots) -> list[float]:
    """The integral of a schedule up to each of its knots."""
    found = [0.0]
    for (t, w), (u, v) in zip(knots, knots[1:]):
        found.append(found[-1] + (u - t) * (w + v) / 2)
    return found


def time_at(share: Column, knots: Knots) -> Column:
    """The time at which a schedule has reached a share of its integral."""
    totals = integrals(knots)
    area = share * totals[-1]
    result = F.lit(1.0)
    for (t, w), (u, v), before, after in reversed(list(zip(knots, knots[1:], totals, totals[1:]))):
        slope = (v - w) / (u - t)
        rest = area - before
        # w x + slope x^2 / 2 = rest, in the form that does not cancel
        x = 2 * rest / (w + F.sqrt(F.greatest(F.lit(w * w) + 2 * slope * rest, F.lit(0.0))))
        result = F.when(area < after, t + F.when(rest > 0, x).otherwise(0.0)).otherwise(result)
    return result


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a tie-break, staged: the texts are read once."""
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    return stage(docs.select("doc_id", "source", size.cast("long").alias("size"), F.xxhash64("text").alias("tie")), "mix-sizes")


def source_targets(sizes: DataFrame, options: MixOptions) -> DataFrame:
    """source, source_size, target, schedule (its number) and start, the words of the sources before it."""
    weights = [integrals(knots)[-1] for knots in options.schedules]
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = running_totals(
        by_source, F.struct(F.col("source").isNull(), F.col("source")),
        {"nth": F.lit(1), "through": F.col("source_size")},
    )
    kind = ((F.col("nth") - 1) % len(weights)).cast("int")
    weighed = placed.select(
        "source", "nth", "source_size", (F.col("through") - F.col("source_size")).alias("start"), kind.alias("schedule"),
        F.element_at(F.array(*[F.lit(w) for w in weights]), kind + 1).alias("weight"),
        (options.max_epochs * F.col("source_size")).alias("cap"),
    )
    whole = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    if not whole.words:
        return weighed.select("source", "source_size", F.lit(0.0).alias("target"), "schedule", "start")
    # in this order a source is capped before every source that is capped after it
    order = F.struct((F.col("cap") / F.col("weight")).alias("by"), F.col("nth"))
    filled = stage(
        running_totals(weighed, order, {"caps": F.col("cap"), "weights": F.col("weight")}).withColumn("order", order), "mix-levels"
    )
    rest = F.lit(whole.words) - (F.col("caps") - F.col("cap"))
    among = F.lit(whole.weight) - (F.col("weights") - F.col("weight"))
    free = filled.where(F.col("weight") * rest / among <= F.col("cap"))
    level = free.select(F.min(F.struct("order", rest.alias("rest"), among.alias("among"))).alias("m")).select("m.*").first()
    shared = F.when(F.col("order") < F.struct(F.lit(level.order.by).alias("by"), F.lit(level.order.nth).cast("long").alias("nth")), F.col("cap").cast("double"))
    return filled.select(
        "source", "source_size", shared.otherwise(F.col("weight") * level.rest / level.among).alias("target"), "schedule", "start"
    )


def curriculum(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """One row per use of a document: row, doc_id, source, size, source_size, target, epoch, words, time.

    A document that the mix does not use has one row, without epoch, words and time.
    """
    sizes = sized(docs)
    targets = stage(source_targets(sizes, options), "mix-targets")
    order = F.struct(F.col("source").isNull(), F.col("source"), F.md5(F.col("doc_id").cast("string")), "doc_id", "size", "tie")
    placed = running_totals(sizes, order, {"row": F.lit(1), "through": F.col("size")})
    named = targets.select(F.col("source").alias("_source"), "source_size", "target", "schedule", "start")
    rows = placed.join(named, F.col("source").eqNullSafe(F.col("_source")))
    first = F.col("through") - F.col("size") - F.col("start")
    ends = F.floor("target")

    def use(epoch: Column) -> Column:
        at = first + epoch * F.col("source_size")
        return F.struct(epoch.alias("epoch"), at.alias("at"), F.least(F.col("size"), ends - at).alias("words"))

    uses = F.filter(F.transform(F.array(*[F.lit(e).cast("long") for e in range(options.max_epochs)]), use), lambda u: u["words"] > 0)
    used = rows.select("row", "doc_id", "source", "size", "source_size", "target", "schedule", F.explode_outer(uses).alias("u"))
    share = F.col("u.at") / F.col("target")
    time = F.lit(None).cast("double")
    for n, knots in enumerate(options.schedules):
        time = F.when(F.col("schedule") == n, time_at(share, knots)).otherwise(time)
    return used.select(
        "row", "doc_id", "source", "size", "source_size", "target", "u.epoch", "u.words", F.when(F.col("u.at").isNotNull(), time).alias("time")
    )


def training_order(uses: DataFrame) -> DataFrame:
    """Adds ``start``, the words of the mix before each use; rows are range-partitioned and sorted by time."""
    order = F.struct("time", "row", "epoch")
    placed = running_totals(uses.where("epoch IS NOT NULL"), order, {"through": F.col("words")})
    return placed.withColumn("start", F.col("through") - F.col("words")).drop("through")


def mixed(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """Per document: row, doc_id, source, size, source_size, target, taken, and first_start, where the mix first uses it."""
    uses = stage(curriculum(docs, options), "mix-uses")
    ordered = training_order(uses)
    unused = uses.where("epoch IS NULL").select(*[F.col(c) if c in uses.columns else F.lit(None).cast("long").alias(c) for c in ordered.columns])
    plain = ["row", "doc_id", "source", "size", "source_size", "target"]
    return ordered.unionByName(unused).groupBy(*plain).agg(
        F.coalesce(F.sum("words"), F.lit(0)).alias("taken"), F.min("start").alias("first_start")
    )
