"""Feature matrix, the same for training and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.constants import FEATURES, NUMERIC_FIELDS
from touchline.functions import numbers
from touchline.operators.schema import coerce_numbers
from touchline.operators.stats import scaled_by_maximum

PREFIX = "feature_"


def prepare_entities(df: DataFrame) -> DataFrame:
    """Numeric fields as numbers, and form scaled by its maximum.

    The maximum reads ``df`` once more, so stage one that is costly to compute.
    """
    ready = coerce_numbers(df, NUMERIC_FIELDS)
    if "form" not in df.columns:
        return ready.withColumn("form_normalized", F.lit(0.0))
    return scaled_by_maximum(ready, "form", "form_normalized")


def _number(df: DataFrame, name: str, absent: float | None, fill: float | None = None) -> Column:
    """A column as a number; ``absent`` when the data lacks it, ``fill`` where the value is missing or no number."""
    if name not in df.columns:
        return F.lit(None if absent is None else float(absent)).cast("double")
    if isinstance(df.schema[name].dataType, T.StringType):
        number = numbers.read_number(F.col(name))
    else:
        number = numbers.without_nan(F.col(name).cast("double"))
    return number if fill is None else F.coalesce(number, F.lit(float(fill)))


def derived_features(df: DataFrame) -> dict[str, Column]:
    minutes = _number(df, "minutes", 0)
    points = _number(df, "points_per_game", 0)
    return {
        "minutes_per_game": numbers.minutes_per_game(minutes, _number(df, "starts", 1)),
        "goals_per_90": numbers.rate_per_90(_number(df, "goals_scored", 0), minutes),
        "assists_per_90": numbers.rate_per_90(_number(df, "assists", 0), minutes),
        "bonus_per_90": numbers.rate_per_90(_number(df, "bonus", 0), minutes),
        "transfer_momentum": numbers.transfer_momentum(
            _number(df, "transfers_in_event", 0),
            _number(df, "transfers_out_event", 0),
            _number(df, "selected_by_percent", 1, fill=1),
        ),
        "value_indicator": numbers.value_for_cost(points, _number(df, "now_cost", 0)),
        "minutes_reliability": numbers.minutes_reliability(minutes),
        "consistency_score": numbers.consistency(points),
        "recent_form_trend": numbers.form_trend(_number(df, "form", 0, fill=0), points),
    }


def with_features(df: DataFrame, features: Sequence[str] = FEATURES, prefix: str = PREFIX) -> DataFrame:
    """Add every feature as ``prefix + name`` in one projection; absent and missing ones are 0."""
    derived = derived_features(df)
    columns = {
        prefix + name: F.coalesce(derived[name] if name in derived else _number(df, name, 0), F.lit(0.0)) for name in features
    }
    return df.withColumns(columns)


def feature_matrix(df: DataFrame, keep: Sequence[str] = ("id",), features: Sequence[str] = FEATURES) -> DataFrame:
    """The features under their own names, after the ``keep`` columns."""
    built = with_features(df, features)
    return built.select(*keep, *[F.col(PREFIX + name).alias(name) for name in features])
