"""Edits of texts by spans: which of them count, and the texts they leave.

Spans are rows (key, start, end, value) in code points, from ``start`` up to but without ``end``. They come from nested
structures, so two of one text are disjoint or one holds the other; of those inside one another the outermost counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def outermost(spans: DataFrame, key: str) -> DataFrame:
    """Spans that begin no earlier than everything before them ends; of equal ones that of the least value."""
    order = W.partitionBy(key).orderBy("start", F.desc("end"), "value").rowsBetween(W.unboundedPreceding, -1)
    return spans.withColumn("_before", F.max("end").over(order)).where("coalesce(start >= _before, true)").drop("_before")


def splice(files: DataFrame, spans: DataFrame, key: str, text: str = "content") -> DataFrame:
    """Replaces the outermost spans of every text by their values. Texts move once, next to one list of spans each."""
    kept = outermost(spans, key).groupBy(F.col(key).alias("_key")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "value"))).alias("_spans")
    )
    joined = files.join(kept, files[key] == F.col("_key"), "left")

    def piece(span, n):
        done = F.when(n == 0, 0).otherwise(F.get("_spans", n - 1)["end"])
        return F.concat(F.substr(text, (done + 1).cast("int"), (span["start"] - done).cast("int")), F.coalesce(span["value"], F.lit("")))

    rest = F.substr(F.col(text), (F.element_at("_spans", -1)["end"] + 1).cast("int"))
    edited = F.concat(F.array_join(F.transform("_spans", piece), ""), rest)
    return joined.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(edited)).select(*files.columns)
