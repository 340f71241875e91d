"""Snapshot statistics."""

from pyspark.sql import functions as F

from driver_queries import bindings as b
from driver_queries.read_queries import CLAUSES
from driver_queries.registry import query
from touchline.operators import stats
from touchline.operators.filters import not_finished
from touchline.operators.schema import coerce_numbers


@query(
    "snapshot_stats",
    b.with_(
        *CLAUSES,
        """SELECT count(*) AS total_players,
                  round(CAST(sum(CAST(predicted_points AS DECIMAL(18,6))) AS DOUBLE) / count(predicted_points), 6) AS avg_predicted_points,
                  max(predicted_points) AS max_predicted_points,
                  (SELECT string_agg(position || ':' || n, ',' ORDER BY position) FROM
                     (SELECT position, count(*) AS n FROM snapshot WHERE position IS NOT NULL GROUP BY position)) AS positions,
                  CAST(count(DISTINCT team) + max(CASE WHEN team IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS teams,
                  'id,team,position,predicted_points' AS columns
           FROM snapshot""",
    ),
)
def snapshot_stats(spark, sf_dir):
    rows = b.snapshot(spark, sf_dir, "id", "team", "position", "predicted_points")
    exact = rows.withColumn("predicted_points", F.col("predicted_points").cast("decimal(18,6)"))
    totals = stats.prediction_statistics(exact)
    entry = lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))
    positions = F.array_join(F.transform(F.map_entries("positions"), entry), ",")
    return totals.select(
        "total_players",
        F.round("avg_predicted_points", 6).alias("avg_predicted_points"),
        "max_predicted_points",
        positions.alias("positions"),
        "teams",
        "columns",
    )


@query(
    "row_counts",
    b.with_(b.PLAYERS_SQL, "SELECT count(*) AS total_rows, count(*) FILTER (WHERE minutes >= 45) AS chosen_rows FROM players"),
)
def row_counts(spark, sf_dir):
    return stats.row_counts(b.players(spark, sf_dir, "minutes"), F.col("minutes") >= 45)


@query(
    "line_statistics",
    """SELECT count(*) AS total_players,
              round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS avg_predicted_points,
              max(l_extendedprice) AS max_predicted_points, count(DISTINCT l_suppkey) AS teams,
              'team,predicted_points' AS columns
       FROM lineitem""",
)
def line_statistics(spark, sf_dir):
    """The same statistics over every order line."""
    lines = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("team"), F.col("l_extendedprice").cast("decimal(18,2)").alias("predicted_points")
    )
    totals = stats.prediction_statistics(lines)
    return totals.withColumn("avg_predicted_points", F.round("avg_predicted_points", 4)).drop("positions")


@query(
    "position_counts",
    """SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'GKP' WHEN 'BUILDING' THEN 'DEF'
                   WHEN 'FURNITURE' THEN 'MID' WHEN 'HOUSEHOLD' THEN 'FWD' END AS position, count(*) AS rows
       FROM customer GROUP BY 1 HAVING position IS NOT NULL""",
)
def position_counts(spark, sf_dir):
    return stats.value_counts(b.snapshot(spark, sf_dir, "position"))


@query("teams_distinct", "SELECT DISTINCT n_name AS team FROM customer JOIN nation ON n_nationkey = c_nationkey")
def teams_distinct(spark, sf_dir):
    return stats.sorted_distinct(b.snapshot(spark, sf_dir, "team"))


@query("names_distinct", "SELECT DISTINCT p_name AS name FROM part WHERE p_name <> ''")
def names_distinct(spark, sf_dir):
    return stats.sorted_distinct(b.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), "name")


@query(
    "smallest_unfinished",
    b.with_(b.FIXTURES_SQL, "SELECT CAST(min(event) AS INTEGER) AS event FROM fixtures WHERE NOT COALESCE(finished, false)"),
)
def smallest_unfinished(spark, sf_dir):
    return stats.smallest_period(b.fixture_periods(spark, sf_dir), not_finished(F.col("finished")))


@query(
    "r2_metric",
    b.with_(
        b.PLAYERS_SQL,
        """SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 5) AS r2
           FROM (SELECT COALESCE(TRY_CAST(points_per_game AS DOUBLE), 0) AS y, COALESCE(TRY_CAST(form AS DOUBLE), 0) AS p
                 FROM players)""",
    ),
)
def r2_metric(spark, sf_dir):
    """Form as a predictor of points per game."""
    rows = coerce_numbers(b.players(spark, sf_dir, "points_per_game", "form"), ["points_per_game", "form"])
    return stats.r_squared(rows, "points_per_game", "form").select(F.round("r2", 5).alias("r2"))
