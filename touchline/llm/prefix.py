"""Running sums within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import stage

_SLOT = "_slot"


def running_before(df: DataFrame, group: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add ``before_<value>``: the sum of a value over the earlier rows of the row's group, 0 for the first.

    Rows are range-partitioned on group and order and written with their slot. A slot sums its own rows; what earlier
    slots of the same group hold is a table of at most one row per slot and group. No group comes into one task. The
    order must be total for a repeatable result. Nulls form a group of their own; null values count as 0.
    """
    taken = stage(df.repartitionByRange(F.col(group), *order).withColumn(_SLOT, F.spark_partition_id()), "ranges")
    totals = taken.groupBy(F.col(group).alias("_group"), F.col(_SLOT).alias("_at")).agg(
        *[F.sum(F.coalesce(F.col(v), F.lit(0))).alias(f"_sum_{v}") for v in values]
    )
    earlier = Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_group", "_at", *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values])
    joined = taken.join(offsets, (F.col(_SLOT) == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")))
    inside = Window.partitionBy(_SLOT, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = [
        (F.col(f"_off_{v}") + F.coalesce(F.sum(F.coalesce(F.col(v), F.lit(0))).over(inside), F.lit(0))).alias(f"before_{v}")
        for v in values
    ]
    return joined.select(*df.columns, *sums)
