"""Pairings (fixtures): the period to use, two sides per pairing, and context attached to entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.constants import DEFAULT_DIFFICULTY, MISSING_OPPONENT
from touchline.functions import numbers, text
from touchline.operators.filters import not_finished, required
from touchline.operators.lookups import keep_last, look_up


def with_team_names(fixtures: DataFrame, teams: DataFrame) -> DataFrame:
    """Add ``home_team`` and ``away_team``; an unknown id gives a missing name."""
    named = look_up(fixtures, teams, {"team_h": "id"}, {"home_team": "name"})
    return look_up(named, teams, {"team_a": "id"}, {"away_team": "name"})


def period_status(calendar: DataFrame, ordinal: str = "pos") -> DataFrame:
    """One row: current and next period. The first flagged row wins; next defaults to current + 1, current to 1."""
    def first_flagged(value: str, flag: str) -> Column:
        return F.min_by(F.when(F.col(flag), F.col(value)), F.when(F.col(flag), F.col(ordinal)))

    raw = calendar.agg(
        first_flagged("id", "is_current").alias("flagged_id"),
        first_flagged("name", "is_current").alias("flagged_name"),
        first_flagged("finished", "is_current").alias("flagged_finished"),
        first_flagged("id", "is_next").alias("next_flagged_id"),
        first_flagged("name", "is_next").alias("next_flagged_name"),
    )
    current = F.coalesce(F.col("flagged_id"), F.lit(1))
    following = F.coalesce(F.col("next_flagged_id"), current + 1)
    default_name = lambda number: F.concat(F.lit("Gameweek "), number.cast("string"))
    return raw.select(
        current.alias("current_id"),
        F.when(F.col("flagged_id").isNull(), default_name(F.lit(1))).otherwise(F.col("flagged_name")).alias("current_name"),
        F.coalesce(F.col("flagged_finished"), F.lit(False)).alias("current_finished"),
        following.alias("next_id"),
        F.when(F.col("next_flagged_id").isNull(), default_name(following)).otherwise(F.col("next_flagged_name")).alias("next_name"),
    )


def target_period(calendar: DataFrame, fixtures: DataFrame, ordinal: str = "pos") -> DataFrame:
    """One row: the next period when it has fixtures, else the smallest period with an unfinished fixture.

    Of the fixtures only ``event`` and ``finished`` are read.
    """
    upcoming = period_status(calendar, ordinal).select("next_id").scalar()
    found = fixtures.agg(
        F.max(F.when(F.col("event") == upcoming, F.col("event"))).alias("planned"),
        F.min(F.when(not_finished(F.col("finished")), F.col("event"))).alias("fallback"),
    )
    return found.select(
        F.coalesce("planned", "fallback").cast("int").alias("gameweek"),
        F.col("planned").isNull().alias("is_fallback"),
    )


def fixtures_of_target(
    calendar: DataFrame, fixtures: DataFrame, ordinal: str = "pos", states: DataFrame | None = None
) -> DataFrame:
    """Fixtures of the target period; under the fallback only its unfinished ones. No period at all is an error.

    ``states`` gives ``event`` and ``finished`` of the same fixtures where that is cheaper than the whole rows. The wanted
    pairs of period and state are one value of one subquery, which runs once before the filter and holds the check.
    """
    target = target_period(calendar, fixtures if states is None else states, ordinal)
    period = required(F.col("gameweek"), "No upcoming fixtures found.")
    state = lambda event, finished: F.struct(event.cast("int").alias("event"), finished.alias("finished"))
    unfinished, any_state = [state(period, F.lit(False))], [state(period, F.lit(False)), state(period, F.lit(True))]
    wanted = target.select(F.when(F.col("is_fallback"), F.array(*unfinished)).otherwise(F.array(*any_state))).scalar()
    return fixtures.where(F.array_contains(wanted, state(F.col("event"), ~not_finished(F.col("finished")))))


def sides(
    pairs: DataFrame,
    home: str = "home_team",
    away: str = "away_team",
    ordinal: Sequence[str] = ("pos",),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Two rows per pair, home side first, by one explode over a single scan."""
    def side(number: int, team: str, opponent: str) -> Column:
        return F.struct(
            F.lit(number).alias("side"),
            F.col(team).alias("team"),
            F.col(opponent).alias("opponent"),
            F.lit(number == 0).alias("is_home"),
        )

    both = F.explode(F.array(side(0, home, away), side(1, away, home))).alias("_side")
    kept = list(dict.fromkeys([*keep, *ordinal]))
    return pairs.select(*kept, both).select(*kept, "_side.*")


def last_side(rows: DataFrame, keys: Sequence[str] = ("team",), ordinal: Sequence[str] = ("pos",)) -> DataFrame:
    """A team that plays more than once keeps its last side."""
    return keep_last(rows, keys, [*ordinal, "side"])


def difficulty_table(teams: DataFrame, ordinal: str = "id", invert: bool = False) -> DataFrame:
    """``team, difficulty``; the first row of a repeated name wins. Stage it before a lookup from many rows."""
    rating = numbers.difficulty_from_strength(F.col("strength"), invert)
    boxed = F.min_by(F.struct(rating.alias("difficulty")), F.col(ordinal))
    first = teams.groupBy(F.col("name").alias("team")).agg(boxed.alias("_first"))
    return first.select("team", "_first.difficulty")


def fixture_info(
    fixtures: DataFrame, difficulty: DataFrame, ordinal: Sequence[str] = ("pos",), every: bool = False
) -> DataFrame:
    """``team, opponent, is_home, difficulty, fixture`` from named fixtures of one period.

    ``every`` keeps all sides of a team instead of the last one. An opponent without a rating row gets the default
    rating; one whose rating is missing keeps it missing.
    """
    rows = sides(fixtures, ordinal=ordinal)
    if not every:
        rows = last_side(rows, ordinal=ordinal)
    rated = look_up(rows, difficulty, {"opponent": "team"}, {"difficulty": "difficulty"}, {"difficulty": DEFAULT_DIFFICULTY})
    fixture = text.fixture_text(F.col("team"), F.col("is_home"), F.col("opponent"))
    return rated.select(*(ordinal if every else ()), "team", "opponent", "is_home", "difficulty", fixture.alias("fixture"))


def attach_fixture(entities: DataFrame, info: DataFrame) -> DataFrame:
    """Left lookup by team; an entity without a fixture gets each column's own default.

    Stage the info first: it holds a row per team, but Catalyst estimates it from the size of all fixtures and would
    shuffle every entity by team. From a written table it knows the size, and broadcasts it if it is small.
    """
    taken = {
        "is_home": "is_home",
        "opponent": "opponent",
        "opponent_difficulty": "difficulty",
        "fixture": "fixture",
        "next_opponent": "opponent",
    }
    defaults = {
        "is_home": False,
        "opponent": "",
        "opponent_difficulty": 0,
        "fixture": "",
        "next_opponent": MISSING_OPPONENT,
    }
    joined = look_up(entities, info, {"team": "team"}, taken, defaults)
    return joined.withColumn(
        "difficulty_adjustment", numbers.difficulty_adjustment(F.col("opponent_difficulty"), F.col("is_home"))
    )
