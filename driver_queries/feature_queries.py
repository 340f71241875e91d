"""Scalars, features and score adjustments."""

from pyspark.sql import functions as F

from driver_queries import bindings as b
from driver_queries.fixture_queries import INFO_CLAUSES, _info
from driver_queries.registry import query
from touchline.constants import FEATURES
from touchline.functions import numbers
from touchline.operators import lookups, pairings
from touchline.operators.features import feature_matrix, prepare_entities
from touchline.operators.filters import active_rows
from touchline.operators.model import finish_scores
from touchline.operators.schema import coerce_numbers
from touchline.operators.stats import scaled_by_maximum
from touchline.session import stage


def _rounded(df, *names):
    return df.withColumns({name: F.round(name, 6) for name in names})


@query(
    "numeric_coerce",
    b.with_(
        b.PLAYERS_SQL,
        """SELECT id, COALESCE(TRY_CAST(form AS DOUBLE), 0) AS form,
                  COALESCE(TRY_CAST(points_per_game AS DOUBLE), 0) AS points_per_game,
                  COALESCE(TRY_CAST(selected_by_percent AS DOUBLE), 1) AS owned,
                  TRY_CAST(selected_by_percent AS DOUBLE) AS owned_or_null FROM players""",
    ),
)
def numeric_coerce(spark, sf_dir):
    rows = b.players(spark, sf_dir, "id", "form", "points_per_game", "selected_by_percent")
    owned = F.col("selected_by_percent")
    rows = rows.withColumns({"owned": numbers.read_number(owned, 1), "owned_or_null": numbers.read_number(owned)})
    return coerce_numbers(rows, ["form", "points_per_game"]).drop("selected_by_percent")


@query(
    "per90_rates",
    b.with_(
        b.PLAYERS_SQL,
        """SELECT id, round(CASE WHEN starts IS NOT NULL THEN minutes / CAST(greatest(starts, 1) AS DOUBLE) END, 6) AS minutes_per_game,
                  round(COALESCE(goals_scored / CAST(greatest(minutes, 1) AS DOUBLE) * 90, 0), 6) AS goals_per_90,
                  round(COALESCE(assists / CAST(greatest(minutes, 1) AS DOUBLE) * 90, 0), 6) AS assists_per_90,
                  round(COALESCE(bonus / CAST(greatest(minutes, 1) AS DOUBLE) * 90, 0), 6) AS bonus_per_90
           FROM players""",
    ),
)
def per90_rates(spark, sf_dir):
    rows = b.players(spark, sf_dir, "id", "starts", "minutes", "goals_scored", "assists", "bonus")
    minutes = F.col("minutes")
    rates = rows.select(
        "id",
        numbers.minutes_per_game(minutes, F.col("starts")).alias("minutes_per_game"),
        numbers.rate_per_90(F.col("goals_scored"), minutes).alias("goals_per_90"),
        numbers.rate_per_90(F.col("assists"), minutes).alias("assists_per_90"),
        numbers.rate_per_90(F.col("bonus"), minutes).alias("bonus_per_90"),
    )
    return _rounded(rates, "minutes_per_game", "goals_per_90", "assists_per_90", "bonus_per_90")


@query(
    "line_rates",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              round(l_tax / greatest(l_discount, 0.01E0) * 90, 6) AS rate, least(l_quantity / 45.0E0, 1.0E0) AS reliability
       FROM lineitem""",
)
def line_rates(spark, sf_dir):
    """Clamped rates over every order line: one projection, no shuffle."""
    lines = b.table(spark, sf_dir, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(numbers.clamped_ratio(F.col("l_tax"), F.col("l_discount"), 0.01) * 90, 6).alias("rate"),
        numbers.minutes_reliability(F.col("l_quantity") * 10).alias("reliability"),
    )


@query(
    "market_features",
    b.with_(
        b.PLAYERS_SQL,
        """SELECT id, round((transfers_in_event - transfers_out_event)
                            / greatest(COALESCE(TRY_CAST(selected_by_percent AS DOUBLE), 1), 0.1E0), 6) AS transfer_momentum,
                  round(COALESCE(TRY_CAST(points_per_game AS DOUBLE) / greatest(now_cost / 10.0E0, 0.1E0), 0), 6) AS value_indicator
           FROM players""",
    ),
)
def market_features(spark, sf_dir):
    rows = b.players(
        spark, sf_dir, "id", "transfers_in_event", "transfers_out_event", "selected_by_percent", "points_per_game", "now_cost"
    )
    owned = numbers.read_number(F.col("selected_by_percent"), 1)
    momentum = numbers.transfer_momentum(F.col("transfers_in_event"), F.col("transfers_out_event"), owned)
    value = numbers.value_for_cost(numbers.read_number(F.col("points_per_game")), F.col("now_cost"))
    return _rounded(
        rows.select("id", momentum.alias("transfer_momentum"), value.alias("value_indicator")),
        "transfer_momentum", "value_indicator",
    )


@query(
    "progression_features",
    b.with_(
        b.PLAYERS_SQL,
        """SELECT id, round(least(minutes / 450.0E0, 1.0E0), 6) AS minutes_reliability,
                  round(1.0E0 / (1.0E0 + ppg * 0.1E0), 6) AS consistency_score,
                  round(CASE WHEN ppg > 0 THEN (frm - ppg) / greatest(ppg, 0.1E0) ELSE 0 END, 6) AS recent_form_trend
           FROM (SELECT id, minutes, COALESCE(TRY_CAST(points_per_game AS DOUBLE), 0) AS ppg,
                        COALESCE(TRY_CAST(form AS DOUBLE), 0) AS frm FROM players)""",
    ),
)
def progression_features(spark, sf_dir):
    rows = coerce_numbers(b.players(spark, sf_dir, "id", "minutes", "points_per_game", "form"), ["points_per_game", "form"])
    points = F.col("points_per_game")
    built = rows.select(
        "id",
        numbers.minutes_reliability(F.col("minutes")).alias("minutes_reliability"),
        numbers.consistency(points).alias("consistency_score"),
        numbers.form_trend(F.col("form"), points).alias("recent_form_trend"),
    )
    return _rounded(built, "minutes_reliability", "consistency_score", "recent_form_trend")


@query(
    "form_normalized",
    b.with_(
        b.PLAYERS_SQL,
        """SELECT id, form, round(CASE WHEN m <> 0 THEN form / m ELSE 0 END, 6) AS form_normalized
           FROM (SELECT id, COALESCE(TRY_CAST(form AS DOUBLE), 0) AS form FROM players),
                (SELECT max(COALESCE(TRY_CAST(form AS DOUBLE), 0)) AS m FROM players)""",
    ),
)
def form_normalized(spark, sf_dir):
    rows = coerce_numbers(b.players(spark, sf_dir, "id", "form"), ["form"])
    return _rounded(scaled_by_maximum(rows, "form", "form_normalized"), "form_normalized")


@query(
    "price_normalized",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              round(l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem), 6) AS price_share FROM lineitem""",
)
def price_normalized(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return _rounded(scaled_by_maximum(lines, "l_extendedprice", "price_share"), "price_share").drop("l_extendedprice")


ACTIVE = """SELECT id, minutes FROM players
  WHERE CASE WHEN (SELECT count(*) FROM players WHERE minutes >= 45) >= {rows} THEN minutes >= 45 ELSE minutes > 0 END"""


@query("active_filter", b.with_(b.PLAYERS_SQL, ACTIVE.format(rows=100)))
def active_filter(spark, sf_dir):
    return active_rows(b.players(spark, sf_dir, "id", "minutes"))


@query("active_filter_fallback", b.with_(b.PLAYERS_SQL, ACTIVE.format(rows=1_000_000_000_000)))
def active_filter_fallback(spark, sf_dir):
    """More rows are asked for than any table has, so every row with minutes stays."""
    return active_rows(b.players(spark, sf_dir, "id", "minutes"), enough_rows=1_000_000_000_000)


_ZERO = ", ".join(
    f"0.0E0 AS {name}"
    for name in FEATURES
    if name
    in (
        "influence", "creativity", "threat", "ict_index", "expected_goals", "expected_assists", "expected_goal_involvements",
        "clean_sheets_per_90", "saves_per_90", "goals_conceded_per_90", "chance_of_playing_next_round",
    )
)


@query(
    "feature_matrix",
    b.with_(
        *INFO_CLAUSES,
        b.PLAYERS_SQL,
        f"""SELECT id, ppg AS points_per_game,
                   round(CASE WHEN m <> 0 THEN frm / m ELSE 0 END, 6) AS form_normalized,
                   round(COALESCE(CASE WHEN starts IS NOT NULL THEN minutes / CAST(greatest(starts, 1) AS DOUBLE) END, 0), 6) AS minutes_per_game,
                   round(goals_scored / CAST(greatest(minutes, 1) AS DOUBLE) * 90, 6) AS goals_per_90,
                   round(assists / CAST(greatest(minutes, 1) AS DOUBLE) * 90, 6) AS assists_per_90,
                   round(bonus / CAST(greatest(minutes, 1) AS DOUBLE) * 90, 6) AS bonus_per_90,
                   COALESCE(TRY_CAST(selected_by_percent AS DOUBLE), 0) AS selected_by_percent,
                   round((transfers_in_event - transfers_out_event)
                         / greatest(COALESCE(TRY_CAST(selected_by_percent AS DOUBLE), 1), 0.1E0), 6) AS transfer_momentum,
                   round(ppg / greatest(now_cost / 10.0E0, 0.1E0), 6) AS value_indicator,
                   round(least(minutes / 450.0E0, 1.0E0), 6) AS minutes_reliability,
                   round(1.0E0 / (1.0E0 + ppg * 0.1E0), 6) AS consistency_score,
                   round(CASE WHEN ppg > 0 THEN (frm - ppg) / greatest(ppg, 0.1E0) ELSE 0 END, 6) AS recent_form_trend,
                   CAST(COALESCE(d, 0) AS DOUBLE) AS opponent_difficulty,
                   round(COALESCE((6 - d) / 10.0E0 * CASE WHEN is_home THEN 1.1E0 ELSE 1.0E0 END, 0), 6) AS difficulty_adjustment,
                   CAST(CASE WHEN is_home THEN 1 ELSE 0 END AS DOUBLE) AS is_home,
                   CAST(COALESCE(chance_of_playing_this_round, 0) AS DOUBLE) AS chance_of_playing_this_round,
                   {_ZERO}
            FROM (SELECT p.*, COALESCE(TRY_CAST(points_per_game AS DOUBLE), 0) AS ppg,
                         COALESCE(TRY_CAST(form AS DOUBLE), 0) AS frm,
                         (SELECT max(COALESCE(TRY_CAST(form AS DOUBLE), 0)) FROM players) AS m,
                         CASE WHEN i.team IS NULL THEN 0 ELSE i.difficulty END AS d, i.is_home
                  FROM players p LEFT JOIN teams t ON t.id = team_id LEFT JOIN info i ON i.team = t.name)""",
    ),
)
def features(spark, sf_dir):
    """All 27 features of every player, with fixture context; absent ones are 0. The players are written once, so that
    the maximum of form comes from them and not from a second pass over the order lines."""
    rows = b.players(spark, sf_dir)
    named = lookups.look_up(rows, b.teams(spark, sf_dir), {"team_id": "id"}, {"team": "name"})
    with_context = stage(pairings.attach_fixture(named, _info(spark, sf_dir)), "entities")
    matrix = feature_matrix(prepare_entities(with_context))
    return matrix.select("id", *[F.round(name, 6).alias(name) for name in FEATURES])


@query(
    "availability_zero",
    b.with_(
        b.PLAYERS_SQL,
        """SELECT id, round(CASE WHEN chance_of_playing_this_round = 0 THEN 0 ELSE ppg * 0.6E0 END, 6) AS predicted_points,
                  now_cost / 10.0E0 AS now_cost, round(ppg * 0.6E0 / 10, 6) AS expected_goals
           FROM (SELECT id, COALESCE(TRY_CAST(points_per_game AS DOUBLE), 0) AS ppg, now_cost, chance_of_playing_this_round
                 FROM players)""",
    ),
)
def availability_zero(spark, sf_dir):
    """Score adjustments, with points per game in place of the model's prediction."""
    rows = b.players(spark, sf_dir, "id", "points_per_game", "now_cost", "chance_of_playing_this_round")
    points = numbers.read_number(F.col("points_per_game"), 0)
    scored = finish_scores(rows.withColumns({"predicted_points": points, "expected_goals": points}))
    return _rounded(scored.select("id", "predicted_points", "now_cost", "expected_goals"), "predicted_points", "expected_goals")
