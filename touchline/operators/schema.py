"""Projections and schema operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.constants import COLUMN_CATALOGUE, DEFAULT_VISIBLE
from touchline.functions import text
from touchline.functions.numbers import read_number, without_nan

ALWAYS_VISIBLE = "name"


def select_renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Keep the columns of ``names`` (old to new), in its order."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def keep_present(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Ordered projection that leaves out columns the data lacks."""
    return df.select(*[name for name in wanted if name in df.columns])


def complete_schema(df: DataFrame, columns: Iterable[str], fill=0.0) -> DataFrame:
    return df.withColumns({name: F.lit(fill) for name in columns if name not in df.columns})


def with_aliases(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Add copies (new to old) beside the originals."""
    return df.withColumns({new: F.col(old) for new, old in names.items()})


def with_full_name(df: DataFrame, first: str = "first_name", last: str = "second_name", name: str = "name") -> DataFrame:
    return df.withColumn(name, text.full_name(F.col(first), F.col(last)))


def coerce_numbers(df: DataFrame, columns: Iterable[str], fill: float | None = 0.0) -> DataFrame:
    """Read the present ones of ``columns`` as numbers; what is no number becomes ``fill``. Whole numbers stay whole."""
    read = {}
    for name in columns:
        if name not in df.columns:
            continue
        kind = df.schema[name].dataType
        if isinstance(kind, T.IntegralType):
            read[name] = F.col(name) if fill is None else F.coalesce(F.col(name), F.lit(fill).cast(kind))
            continue
        if isinstance(df.schema[name].dataType, T.StringType):
            number = read_number(F.col(name))
        else:
            number = without_nan(F.col(name).cast("double"))
        read[name] = number if fill is None else F.coalesce(number, F.lit(float(fill)))
    return df.withColumns(read)


def fill_missing(df: DataFrame, fill_strings: str | None = None) -> DataFrame:
    """Missing numbers become 0 and missing booleans false; texts stay missing unless a fill is named."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    boolean = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    filled = df.fillna(0, subset=numeric) if numeric else df
    filled = filled.fillna(False, subset=boolean) if boolean else filled
    if fill_strings is None:
        return filled
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return filled.fillna(fill_strings, subset=texts) if texts else filled


def toggle(visible: Iterable[str], column: str) -> list[str]:
    """Show a hidden column or hide a visible one; the name column cannot be hidden."""
    shown = list(visible)
    if column not in shown:
        return [*shown, column]
    return shown if column == ALWAYS_VISIBLE else [name for name in shown if name != column]


def visible_columns(df: DataFrame, visible: Iterable[str] = DEFAULT_VISIBLE) -> DataFrame:
    """Visible columns in the order of the catalogue."""
    shown = {*visible, ALWAYS_VISIBLE}
    return keep_present(df, [key for key, *_ in COLUMN_CATALOGUE if key in shown])


def display_table(df: DataFrame, visible: Iterable[str] = DEFAULT_VISIBLE, keep: Iterable[str] = ()) -> DataFrame:
    """Cell texts under the catalogue's labels, after the ``keep`` columns."""
    shown = {*visible, ALWAYS_VISIBLE}
    cells = [
        text.display_value(F.col(key), df.schema[key].dataType.typeName(), kind, decimals).alias(label)
        for key, label, kind, decimals in COLUMN_CATALOGUE
        if key in shown and key in df.columns
    ]
    return df.select(*keep, *cells)


def column_list(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema.fields]


def entity_detail(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Six sections of display texts per entity. Filter on the key first to get a single entity."""
    one = lambda name: text.fixed_decimals(F.col(name).cast("double"), 1)
    whole = lambda name: text.plain_number(F.col(name).cast("double"))
    sections = {
        "predictions": {
            "predicted_points": one("predicted_points"),
            "opponent_difficulty": text.difficulty_out_of_five(F.col("opponent_difficulty")),
            "venue": text.venue_word(F.col("is_home")),
        },
        "value": {
            "price": text.money(F.col("now_cost").cast("double")),
            "points_per_game": one("points_per_game"),
            "total_points": whole("total_points"),
        },
        "performance": {
            "form": one("form"),
            "minutes": whole("minutes"),
            "expected_goals": text.fixed_decimals(F.col("expected_goals").cast("double"), 2),
        },
        "season": {name: whole(name) for name in ("goals_scored", "assists", "clean_sheets")},
        "discipline": {
            "yellow_cards": whole("yellow_cards"),
            "red_cards": whole("red_cards"),
            "saves_per_90": one("saves_per_90"),
        },
        "availability": {
            "chance_of_playing": text.availability_percent(F.col("chance_of_playing_this_round")),
        },
    }
    structs = [
        F.struct(*[value.alias(field) for field, value in fields.items()]).alias(section)
        for section, fields in sections.items()
    ]
    return df.select(*keep, *structs)
