"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.constants import ACTIVE_MINIMUM_ROWS, ACTIVE_MINUTES
from touchline.functions.text import present


class NoRowsError(ValueError):
    """A step that cannot go on without rows got none."""


def in_period(df: DataFrame, period, column: str = "event") -> DataFrame:
    """``period`` is a number or a one-row subquery column."""
    return df.where(F.col(column) == period)


def not_finished(finished: Column) -> Column:
    """An unknown state counts as not finished."""
    return ~F.coalesce(finished, F.lit(False))


def text_matches(value: Column, wanted: str, literal: bool = False) -> Column:
    """Case-insensitive search; ``wanted`` is a regular expression unless ``literal``."""
    if literal:
        found = F.contains(F.lower(value), F.lower(F.lit(wanted)))
    else:
        found = value.rlike(f"(?iu){wanted}")
    return F.coalesce(found, F.lit(False))


def matching_rows(
    df: DataFrame, team: str = "", position: str = "", search: str = "", literal: bool = False
) -> DataFrame:
    """Rows that meet every given condition; an empty argument is no condition."""
    if team:
        df = df.where(text_matches(F.col("team"), team, literal))
    if position:
        df = df.where(F.col("position") == position)
    if search:
        df = df.where(text_matches(F.col("name"), search, literal))
    return df


def truthy_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(present(F.col(column)))


def active_rows(
    df: DataFrame,
    minutes: str = "minutes",
    enough_minutes: int = ACTIVE_MINUTES,
    enough_rows: int = ACTIVE_MINIMUM_ROWS,
) -> DataFrame:
    """Rows with enough minutes, or with any minutes when too few have enough.

    The count is a scalar subquery of the same plan, so the choice needs no round trip to the driver.
    """
    played = F.col(minutes) >= enough_minutes
    plenty = df.agg(F.count_if(played) >= enough_rows).scalar()
    return df.where(F.when(plenty, played).otherwise(F.col(minutes) > 0))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise NoRowsError(message)
    return df


def required(value: Column, message: str) -> Column:
    """The value, or an error of the running query when it is missing."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(message)))
