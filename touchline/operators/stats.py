"""Aggregates over a snapshot. Every one combines partial results before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.filters import truthy_rows
from touchline.operators.schema import column_list


def row_counts(df: DataFrame, chosen: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(chosen).alias("chosen_rows"))


def distinct_with_missing(column: str) -> Column:
    """Number of distinct values, with a missing value counted as one more; 0 for no rows."""
    return F.count_distinct(F.col(column)) + F.coalesce(F.max(F.when(F.col(column).isNull(), 1).otherwise(0)), F.lit(0))


def smallest_period(fixtures: DataFrame, condition: Column, column: str = "event") -> DataFrame:
    return fixtures.agg(F.min(F.when(condition, F.col(column))).alias(column))


def value_counts(df: DataFrame, column: str = "position") -> DataFrame:
    """Frequency of the present values, largest first."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return counted.orderBy(F.desc("rows"), F.asc(column))


def sorted_distinct(df: DataFrame, column: str = "team") -> DataFrame:
    return truthy_rows(df.select(column), column).distinct().orderBy(column)


def prediction_statistics(df: DataFrame) -> DataFrame:
    """One row: row count, mean and maximum prediction, rows per position, number of teams, column names.

    The rows are read once. They combine to partials by position and team before the first shuffle, and the partials roll up by
    position for the map and by team for the number of teams. Without a column its figures are 0 or empty. The map holds
    one entry per position.
    """
    has = lambda name: name in df.columns
    points = F.col("predicted_points") if has("predicted_points") else F.lit(0.0)
    label = lambda name: (F.col(name) if has(name) else F.lit(None).cast("string")).alias(f"_{name}")
    given = df.select(label("position"), label("team"), points.alias("_points"))
    parts = given.groupBy("_position", "_team").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("_points").alias("_sum"), F.count("_points").alias("_known"), F.max("_points").alias("_best")
    )
    sides = parts.groupingSets([["_position"], ["_team"]], "_position", "_team").agg(
        F.grouping("_team").alias("_by_position"), *[F.sum(name).alias(name) for name in ("_rows", "_sum", "_known")], F.max("_best").alias("_best")
    )
    of_position = F.col("_by_position") == 1
    total = lambda name: F.sum(F.when(of_position, F.col(name)))
    entry = F.when(of_position & F.col("_position").isNotNull(), F.struct(F.col("_position").alias("position"), F.col("_rows").alias("rows")))
    totals = sides.agg(
        F.coalesce(total("_rows"), F.lit(0)).alias("total_players"),
        F.try_divide(total("_sum").cast("double"), total("_known")).alias("avg_predicted_points"),
        F.max(F.when(of_position, F.col("_best"))).cast("double").alias("max_predicted_points"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("positions"),
        (F.count_if(~of_position) if has("team") else F.lit(0)).cast("long").alias("teams"),
    )
    listed = F.lit(",".join(column_list(df)))
    return totals.select("total_players", "avg_predicted_points", "max_predicted_points", "positions", "teams", listed.alias("columns"))


def scaled_by_maximum(df: DataFrame, column: str, alias: str) -> DataFrame:
    """``column`` over its global maximum, 0 when that is 0 or missing; the maximum is a scalar subquery."""
    largest = df.agg(F.max(column)).scalar()
    return df.withColumn(alias, F.when(largest != 0, F.col(column) / largest).otherwise(F.lit(0.0)))


def r_squared(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Coefficient of determination in one pass."""
    both = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    error = F.col(actual) - F.col(predicted)
    spread = F.var_pop(actual) * F.count(F.lit(1))
    return both.agg((F.lit(1.0) - F.try_divide(F.sum(error * error), spread)).alias("r2"))
