"""Equi-lookups on dimensions, and one row per key.

No side is hinted for broadcast: Catalyst broadcasts a dimension whose size it knows to be small, and adaptive execution
splits hot keys where it is not. For both, a dimension must be a table and not the result of an aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import stage

MATCHED = "_matched"


def _one_per_key(df: DataFrame, keys: Sequence[str], ordinal: Sequence[str], pick) -> DataFrame:
    rest = [name for name in df.columns if name not in keys]
    if not rest:
        return df.select(*keys).distinct()
    row = F.struct(*[F.col(name) for name in rest])
    order = F.struct(*[F.col(name) for name in ordinal])
    return df.groupBy(*keys).agg(pick(row, order).alias("_row")).select(*keys, *[F.col("_row")[name].alias(name) for name in rest])


def keep_last(df: DataFrame, keys: Sequence[str], ordinal: Sequence[str]) -> DataFrame:
    """The row with the largest ordinal per key; aggregated on the map side, so a hot key stays small."""
    return _one_per_key(df, keys, ordinal, F.max_by)


def keep_first(df: DataFrame, keys: Sequence[str], ordinal: Sequence[str]) -> DataFrame:
    return _one_per_key(df, keys, ordinal, F.min_by)


def lookup_table(df: DataFrame, keys: Sequence[str], ordinal: Sequence[str]) -> DataFrame:
    """The last row per key, written as a table to look up in.

    Joined straight from its aggregation, a dimension shares the aggregation's shuffle, and adaptive execution then
    cannot split a hot key of the other side; nor does Catalyst know how small the dimension is. The written table has
    neither fault.
    """
    return stage(keep_last(df, keys, ordinal), "lookup")


def name_table(source: DataFrame, ordinal: Sequence[str] = ("pos",)) -> DataFrame:
    """``full_name, code``: the last code of each name in ``source``, written as a table to look up in.

    It is made once, by the job or beside a published snapshot, and not for each request.
    """
    ordered = source.select("full_name", "code", *[F.col(column).alias(f"_at_{i}") for i, column in enumerate(ordinal)])
    return lookup_table(ordered, ["full_name"], [f"_at_{i}" for i in range(len(ordinal))]).select("full_name", "code")


def look_up(
    df: DataFrame,
    dim: DataFrame,
    on: Mapping[str, str],
    take: Mapping[str, str],
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """Left lookup in a dimension that is unique per key.

    ``on`` maps a column of ``df`` to the key in ``dim``; ``take`` maps each new column to a column of ``dim``. A row
    without a match gets ``defaults`` (missing where not named); a missing value of a matching row stays missing. A new
    column replaces one of the same name.
    """
    defaults = defaults or {}
    wanted = dim.select(
        *[F.col(key).alias(f"_key_{i}") for i, key in enumerate(on.values())],
        *[F.col(column).alias(f"_take_{i}") for i, column in enumerate(take.values())],
        F.lit(True).alias(MATCHED),
    )
    condition = [df[column] == wanted[f"_key_{i}"] for i, column in enumerate(on)]
    joined = df.join(wanted, condition, "left")
    found = {}
    for i, new in enumerate(take):
        value = F.col(f"_take_{i}")
        if new in defaults:
            value = F.when(F.col(MATCHED).isNull(), F.lit(defaults[new])).otherwise(value)
        found[new] = value
    kept = [F.col(name) for name in df.columns if name not in found]
    return joined.select(*kept, *[value.alias(new) for new, value in found.items()])


def code_label(code: Column, labels: Mapping[int, str]) -> Column:
    """Label of a known code, missing for others."""
    chain = None
    for known, label in labels.items():
        chain = F.when(code == known, label) if chain is None else chain.when(code == known, label)
    return chain


def enrich_by_name(
    df: DataFrame,
    source: DataFrame | None,
    ordinal: Sequence[str] = ("pos",),
    name: str = "name",
    code: str = "player_code",
) -> DataFrame:
    """Overwrite the code by the one that ``source`` (``full_name, code`` and the ordinal) gives last for the name.

    Without a source the code is missing everywhere. A ``name_table`` is unique already and has no ordinal: use it where
    rows are many or requests repeat.
    """
    if source is None:
        return df.withColumn(code, F.lit(None).cast("long"))
    if set(ordinal) <= set(source.columns):
        source = keep_last(source.select("full_name", "code", *[F.col(c).alias(f"_at_{i}") for i, c in enumerate(ordinal)]), ["full_name"], [f"_at_{i}" for i in range(len(ordinal))])
    return look_up(df, source, {name: "full_name"}, {code: "code"})
