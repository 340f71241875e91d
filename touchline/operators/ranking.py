"""Sorting, limits and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.constants import NUMERIC_SORT_COLUMNS
from touchline.functions.numbers import without_nan
from touchline.operators.schema import coerce_numbers
from touchline.session import stage

STORED_BY = "predicted_points"
#: Up to this limit one task takes the first rows of all, and up to this k one task takes those of a group.
LARGE_LIMIT, LARGE_K = 10_000, 1000
_SLOT_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def best_first(column: str, tiebreak: str = "id") -> list[Column]:
    """Largest first; what is no number comes last, with the missing ones."""
    value = F.col(column)
    return [F.desc_nulls_last(F.when(~F.isnan(value), value)), F.asc(tiebreak)]


def requested_order(
    df: DataFrame, sort_by: str = "predicted_points", sort_order: str = "desc", tiebreak: str = "id"
) -> tuple[DataFrame, list[Column]]:
    """Order asked for by name; missing values last both ways; an unknown column gives the order of a published snapshot."""
    if sort_by not in df.columns:
        return df, best_first(STORED_BY, tiebreak) if STORED_BY in df.columns else [F.asc(tiebreak)]
    if sort_by in NUMERIC_SORT_COLUMNS:
        df = coerce_numbers(df, [sort_by], fill=None)
    direction = F.asc_nulls_last if sort_order == "asc" else F.desc_nulls_last
    return df, [direction(sort_by), F.asc(tiebreak)]


def client_order(df: DataFrame, sort_by: str = "predicted_points", sort_order: str = "desc", tiebreak: str = "id") -> list[Column]:
    """Missing numbers sort as 0 and missing flags as false; missing texts sort last."""
    value = F.col(sort_by)
    kind = df.schema[sort_by].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        value = F.coalesce(without_nan(value) if isinstance(kind, (T.DoubleType, T.FloatType)) else value, F.lit(0).cast(kind))
    direction = value.asc_nulls_last() if sort_order == "asc" else value.desc_nulls_last()
    return [direction, F.asc(tiebreak)]


def take_sorted(df: DataFrame, order: Sequence[Column], limit: int = 0) -> DataFrame:
    """All rows in order, or the first ``limit`` when that is positive.

    Spark ends a limit in one task. Beyond ``LARGE_LIMIT`` rows are range-partitioned on the order and written with their slot
    instead, counts per part tell in which slot the limit falls, and later slots are not taken.
    """
    if limit <= 0:
        return df.orderBy(*order)
    return df.orderBy(*order).limit(limit) if limit <= LARGE_LIMIT else _first_slots(df, order, limit)


def _first_slots(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    laid_out = df.repartitionByRange(*order).sortWithinPartitions(*order)
    slots = stage(laid_out.withColumn("_slot", F.monotonically_increasing_id()), "sorted")
    parts = slots.groupBy(F.shiftright(F.col("_slot"), _SLOT_BITS).alias("_part")).agg(F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    upto = F.sum("_rows").over(Window.orderBy("_part"))  # over one row for each part, not over the rows
    reached = parts.withColumn("_upto", upto).where(F.col("_upto") >= limit)
    end = reached.agg(F.min(F.col("_first") + F.col("_rows") + limit - F.col("_upto"))).scalar()
    taken = slots.where(F.col("_slot") < F.coalesce(end, F.lit(2**63 - 1)))
    return taken.orderBy("_slot").select(*df.columns)


def numbered(top: DataFrame, alias: str = "rank") -> DataFrame:
    """Number the rows of a ``take_sorted`` result with a limit up to ``LARGE_LIMIT``: those leave the top-k as one ordered partition."""
    return top.withColumn(alias, F.monotonically_increasing_id() + 1)


def rank_rows(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), alias: str = "rank") -> DataFrame:
    """Exact position of every row within its group (or overall), with no group tied to one task.

    A window would bring a whole group to one task. Here rows are range-partitioned on group and order, so a hot group
    spreads over many tasks; each row is written with its slot, and a table of one row per task and group turns slots
    into ranks; its running sum is over that small table only. ``order`` must be total.
    """
    keys = [*[F.asc(name) for name in by], *order]
    laid_out = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    slots = stage(laid_out.withColumn("_slot", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(F.col("_slot"), _SLOT_BITS).alias("_part")
    runs = slots.groupBy(*by, part).agg(F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        *[F.col(name).alias(f"_by_{name}") for name in by],
        "_part",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    # Written too, so that the join knows its size and need not move the rows when it is small.
    starts = stage(starts, "rank-starts")
    rows = slots.withColumn("_row_part", part)
    same_run = rows["_row_part"] == starts["_part"]
    for name in by:
        same_run = same_run & rows[name].eqNullSafe(starts[f"_by_{name}"])
    return rows.join(starts, same_run).select(*df.columns, (F.col("_slot") + F.col("_shift")).alias(alias))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, alias: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group. Each task keeps only ``k`` rows per group before the shuffle.

    Beyond ``LARGE_K`` that would bring whole groups to one task, so all rows are ranked over range partitions and cut; ``order``
    must be total then.
    """
    if k > LARGE_K:
        return rank_rows(df, order, by, alias).where(F.col(alias) <= k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(alias, rank).where(F.col(alias) <= k)
