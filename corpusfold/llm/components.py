"""Connected components of a link table, as Spark jobs that contract the graph until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfold.session import stage


def _relabel(table: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    found = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    others = [c for c in table.columns if c != column]
    return table.join(found, F.col(column) == F.col("_node"), "left").select(
        *others, F.coalesce("_parent", column).alias(column)
    )


def connected_components(links: DataFrame, jumps: int = 3) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns a, b); the component is its smallest node.

    In a round every node hooks to its smallest neighbour, pointers are followed ``2 ** jumps`` steps, and
    edges move to where their ends point. Stars and chains shrink in a round or two. Hubs are aggregated
    before the shuffle; each round's tables are written, so a lost executor costs only its own tasks.
    """
    edges = stage(links.select("a", "b").where("a <> b").distinct(), "edges")
    labels = stage(
        edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels"
    )
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        parents = both.groupBy("node").agg(F.min("other").alias("parent")).select("node", F.least("node", "parent").alias("parent"))
        parents = stage(parents, "parents")
        for _ in range(jumps):
            parents = _relabel(parents, "parent", parents).select("node", "parent")
            parents = stage(parents, "parents")
        labels = stage(_relabel(labels, "component", parents).select("node", "component"), "labels")
        moved = _relabel(_relabel(edges, "a", parents), "b", parents)
        edges = stage(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels
