"""Queries on a published snapshot: filter, sort, limit, fill; and the same with names and images looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import text
from touchline.operators.filters import NoRowsError, matching_rows
from touchline.operators.lookups import enrich_by_name, name_table
from touchline.operators.ranking import requested_order, take_sorted
from touchline.operators.schema import fill_missing
from touchline.operators.stats import prediction_statistics, sorted_distinct
from touchline.sources import readers, writers


def predictions_query(
    df: DataFrame,
    team: str = "",
    position: str = "",
    search: str = "",
    sort_by: str = "predicted_points",
    sort_order: str = "desc",
    limit: int = 0,
    literal: bool = False,
    tiebreak: str = "id",
    fill_strings: str | None = None,
) -> DataFrame:
    """Rows that match every given condition, in the order asked for, with missing values filled; one plan.

    An unknown column leaves the order in which a snapshot is published, best prediction first.
    """
    rows = matching_rows(df, team, position, search, literal)
    rows, order = requested_order(rows, sort_by, sort_order, tiebreak)
    rows = take_sorted(rows, order, limit)
    return fill_missing(rows, fill_strings)


def _named(entities: DataFrame) -> DataFrame:
    name = text.full_name(F.col("first_name"), F.col("second_name"))
    return entities.select(name.alias("full_name"), "code", "pos")


def names_of(entities: DataFrame) -> DataFrame:
    """Names and codes of entity rows, written once for many calls of ``serve_predictions``."""
    return name_table(_named(entities))


def with_image_address(df: DataFrame, source: DataFrame | None) -> DataFrame:
    """Code by full name from entity rows or from a table of ``names_of``, and the address built from it."""
    if source is not None and "full_name" not in source.columns:
        source = _named(source)
    enriched = enrich_by_name(df, source)
    return enriched.withColumn("image_url", text.image_address(F.col("player_code")))


def with_image_sources(df: DataFrame) -> DataFrame:
    """Addresses to try per entity, in order, and the initials of its name."""
    avatar = text.avatar_address(F.col("name"), F.col("position"))
    stored = [F.col(f"image_url_{place}") for place in ("primary", "secondary", "tertiary")]
    sources = text.image_sources(*stored, F.col("player_code"), avatar)
    return df.withColumns({"image_sources": sources, "initials": text.initials(F.col("name"))})


def serve_predictions(
    spark: SparkSession, folder: str, source: DataFrame | None = None, **arguments
) -> tuple[DataFrame, DataFrame]:
    """Rows of the latest CSV snapshot that ``predictions_query`` selects, and their one-row metadata.

    Ties go to the smaller ``id``, or to the smaller name in an export without ids.
    """
    period = readers.latest_period(spark, folder)
    if period is None:
        raise NoRowsError("No prediction CSV files found")
    path = readers.snapshot_path(folder, period)
    rows = readers.read_predictions(spark, path)
    tiebreak = "id" if "id" in rows.columns else "name"
    shown = predictions_query(with_image_address(rows, source), **{"tiebreak": tiebreak, **arguments})
    # The counts need neither the lookup nor the sort.
    conditions = {name: arguments[name] for name in ("team", "position", "search", "literal") if name in arguments}
    matching = matching_rows(rows, **conditions)
    return shown, writers.response_metadata(rows, matching, period, path.rsplit("/", 1)[-1], arguments.get("limit", 0))


def serve_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The one-row statistics of the latest CSV snapshot, found by its name; its columns are those of the file."""
    period = readers.latest_period(spark, folder)
    if period is None:
        raise NoRowsError("No prediction CSV files found")
    rows = readers.read_predictions(spark, readers.snapshot_path(folder, period))
    return prediction_statistics(rows).withColumn("gameweek", F.lit(period))


def serve_teams(spark: SparkSession, folder: str) -> DataFrame:
    """The teams of the latest CSV snapshot, each once, in order."""
    return sorted_distinct(readers.read_latest(spark, folder), "team")
