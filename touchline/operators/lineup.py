"""Best legal line-up per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.constants import FALLBACK_FORMATION, FORMATIONS, POSITIONS, TEAM_SIZE
from touchline.functions.numbers import without_nan
from touchline.functions.text import fixed_decimals, money
from touchline.operators.ranking import best_first, top_per_group

KEEPER, DEFENDER, MIDFIELDER, FORWARD = POSITIONS.values()
_EXACT = "decimal(18,6)"  # totals must tie exactly and not depend on the order of the sum
_WIDEST = max(max(shape) for _, *shape in FORMATIONS)


def _formation(name: str, defenders: int, midfielders: int, forwards: int) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(defenders).alias("def"),
        F.lit(midfielders).alias("mid"),
        F.lit(forwards).alias("fwd"),
    )


def _squads(df: DataFrame, by: Sequence[str], points: str, cost: str | None, key: str, keep: Sequence[str]) -> DataFrame:
    """One row per group: its few candidate players and the chosen formation."""
    number = lambda name: F.coalesce(without_nan(F.col(name).cast("double")), F.lit(0.0))
    # Rows of no known position stay, a few of each group, so that a group without any other has its summary.
    known = F.when(F.col("position").isin(*POSITIONS.values()), F.col("position"))
    candidates = df.select(
        *by,
        known.alias("position"),
        F.col(key).alias("_key"),
        number(points).alias("_points"),
        (number(cost) if cost else F.lit(0.0)).alias("_cost"),
        *keep,
    )
    top = top_per_group(candidates, [*by, "position"], best_first("_points", "_key"), _WIDEST, "_rank")

    exact = F.col("_points").cast(_EXACT)
    needed = {KEEPER: {1}, DEFENDER: set(), MIDFIELDER: set(), FORWARD: set()}
    for _, *shape in FORMATIONS:
        for position, count in zip((DEFENDER, MIDFIELDER, FORWARD), shape):
            needed[position].add(count)
    sums = [
        F.sum(F.when((F.col("position") == position) & (F.col("_rank") <= count), exact)).alias(f"_sum_{position}_{count}")
        for position, counts in needed.items()
        for count in sorted(counts)
    ]
    counts = [F.count_if(F.col("position") == position).alias(f"_count_{position}") for position in needed]
    # At most _WIDEST rows per position reach this list, whatever the size of the group.
    player = F.struct("position", F.col("_rank").alias("slot"), "_key", "_points", "_cost", *keep)
    packed = top.groupBy(*by).agg(F.collect_list(F.when(F.col("position").isNotNull(), player)).alias("_players"), *sums, *counts)

    options = []
    for preference, (name, defenders, midfielders, forwards) in enumerate(FORMATIONS):
        shape = {KEEPER: 1, DEFENDER: defenders, MIDFIELDER: midfielders, FORWARD: forwards}
        enough, total = F.lit(True), F.lit(0).cast(_EXACT)
        for position, count in shape.items():
            enough = enough & (F.col(f"_count_{position}") >= count)
            total = total + F.col(f"_sum_{position}_{count}")
        option = F.struct(
            total.alias("total"),
            F.lit(-preference).alias("preference"),
            _formation(name, defenders, midfielders, forwards).alias("formation"),
        )
        options.append(F.when(enough & (total > 0), option))
    best = F.array_max(F.array(*options))
    return packed.select(
        *by, "_players", F.coalesce(best["formation"], _formation(*FALLBACK_FORMATION)).alias("_formation")
    )


def _selected(squads: DataFrame) -> Column:
    shape = F.col("_formation")

    def fits(player: Column) -> Column:
        limit = (
            F.when(player["position"] == KEEPER, 1)
            .when(player["position"] == DEFENDER, shape["def"])
            .when(player["position"] == MIDFIELDER, shape["mid"])
            .otherwise(shape["fwd"])
        )
        return player["slot"] <= limit

    return F.filter("_players", fits)


def best_eleven(
    df: DataFrame,
    by: Sequence[str] = (),
    points: str = "predicted_points",
    cost: str | None = "now_cost",
    key: str = "id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per selected player: group, formation, position, slot, key, points, cost.

    The formation with the largest positive total wins, the earlier one on a tie; without a feasible formation the
    fallback shape takes what there is. Ties between players go to the smaller key.
    """
    squads = _squads(df, by, points, cost, key, keep)
    chosen = squads.select(*by, F.col("_formation.name").alias("formation"), F.explode(_selected(squads)).alias("_player"))
    return chosen.select(
        *by,
        "formation",
        F.col("_player.position").alias("position"),
        F.col("_player.slot").alias("slot"),
        F.col("_player._key").alias(key),
        F.col("_player._points").alias(points),
        *([F.col("_player._cost").alias(cost)] if cost else []),
        *[F.col("_player")[name].alias(name) for name in keep],
    )


def best_eleven_summary(
    df: DataFrame,
    by: Sequence[str] = (),
    points: str = "predicted_points",
    cost: str | None = "now_cost",
    key: str = "id",
) -> DataFrame:
    """One row per group: formation, size, total points and cost, average over a full team.

    A group without candidates has the fallback formation and totals of 0.
    """
    squads = _squads(df, by, points, cost, key, ())
    rows = squads.select(*by, F.col("_formation.name").alias("formation"), _selected(squads).alias("_team"))

    def total(field: str) -> Column:
        zero = F.lit(0).cast("decimal(38,6)")
        return F.aggregate("_team", zero, lambda sum_, p: (sum_ + p[field].cast(_EXACT)).cast("decimal(38,6)")).cast("double")

    return rows.select(
        *by,
        "formation",
        F.size("_team").alias("players"),
        total("_points").alias("total_points"),
        total("_cost").alias("total_cost"),
        (total("_points") / TEAM_SIZE).alias("average_points"),
    )


def lineup_texts(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summary rows as they are shown: total, cost, average and formation."""
    one = lambda name: fixed_decimals(F.col(name), 1)
    return summary.select(
        *by,
        one("total_points").alias("total_points"),
        money(F.col("total_cost")).alias("team_cost"),
        one("average_points").alias("average_points"),
        "formation",
    )
