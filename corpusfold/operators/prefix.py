"""Running totals over one global order, without a single-partition window.

Rows are range-partitioned on a unique key, so every partition holds a similar share whatever the
skew of the leading key column. Each partition is then summed on its own and shifted by the totals
of the partitions before it; that table has one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusfold.session import stage

_PART = "_part"


def running_totals(df: DataFrame, order: Column, totals: dict[str, Column]) -> DataFrame:
    """Inclusive running sums of ``totals`` along ``order`` (a unique sort key), next to the other columns."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # staged, because range boundaries are sampled: every later pass must see the same partition numbers
    ranged = stage(
        df.repartitionByRange(parts, order).withColumn(_PART, F.spark_partition_id()), "ranged"
    )
    before = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(_PART)
        .agg(*[F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()])
        .select(
            _PART,
            *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_off_{name}") for name in totals],
        )
    )
    inside = W.partitionBy(_PART).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    summed = ranged.select(
        "*", *[F.sum(value).over(inside).alias(f"_in_{name}") for name, value in totals.items()]
    )
    # at most one row per shuffle partition, so the broadcast cannot grow with the data
    return summed.join(F.broadcast(offsets), _PART).select(
        *[name for name in df.columns if name not in totals],
        *[(F.col(f"_in_{name}") + F.col(f"_off_{name}")).alias(name) for name in totals],
    )
