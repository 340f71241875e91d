"""The engine's input tables, bound onto the driver's tables; each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.constants import POSITIONS
from touchline.functions import numbers, text
from touchline.operators import lookups

RECENT_FROM = "2001-01-01"
FIRST_DAY = "1995-01-01"
POSITION_CODES = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4}
FROM_ORDERS = ("starts", "minutes", "goals_scored", "assists", "bonus", "clean_sheets", "points_per_game", "form")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer. Lines are summed per order first, which halves what is shuffled twice and makes the count of
    orders a plain count instead of a distinct one.

    Lines are dealt by order before they are summed: a table of the orders in its part of the file would grow with each scan task, while
    shuffled parts keep their size and grow in number."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey").isNotNull())
    per_order = (
        lines.select("l_orderkey", "l_quantity", "l_returnflag", "l_discount", "l_linestatus", "l_extendedprice")
        .repartition("l_orderkey")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.sum(F.col("l_quantity").cast("int")).alias("minutes"),
            F.count_if(F.col("l_returnflag") == "R").alias("goals_scored"),
            F.count_if(F.col("l_returnflag") == "A").alias("assists"),
            F.count_if(F.col("l_discount") > 0.085).alias("bonus"),
            F.count_if(F.col("l_linestatus") == "F").alias("clean_sheets"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("value"),
        )
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    recent = F.col("o_orderdate") >= F.lit(RECENT_FROM).cast("timestamp")
    summed = [F.sum(name).alias(name) for name in ("minutes", "goals_scored", "assists", "bonus", "clean_sheets", "value")]
    return (
        orders.join(per_order, "o_orderkey")
        .groupBy(F.col("o_custkey").alias("customer"))
        .agg(
            F.count(F.lit(1)).alias("starts"),
            *summed,
            F.sum(F.when(recent, F.col("value"))).alias("recent_value"),
            F.count_if(recent).alias("recent_starts"),
        )
    )


def players(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Customers as entities; the order totals are joined only when one of their columns is asked for."""
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    position = None
    for segment, code in POSITION_CODES.items():
        is_segment = F.col("c_mktsegment") == segment
        position = F.when(is_segment, code) if position is None else position.when(is_segment, code)
    built = {
        "id": key,
        "code": key,
        "first_name": F.col("c_mktsegment"),
        "second_name": F.col("c_name"),
        "team_id": F.col("c_nationkey"),
        "element_type": position.otherwise(5),
        "selected_by_percent": F.when(key % 19 == 0, "bad").otherwise(F.round((key % 400) / 10, 1).cast("string")),
        "now_cost": F.when(F.col("c_acctbal") <= 0, 0).otherwise(F.floor(F.col("c_acctbal") / 100)).cast("long"),
        "transfers_in_event": key * 7 % 1000,
        "transfers_out_event": key * 13 % 1000,
        "chance_of_playing_this_round": F.when(key % 6 == 0, 0).when(key % 6 == 1, 25).when(key % 6 == 2, 75).when(key % 6 == 3, 100),
    }
    if not columns or set(columns) & set(FROM_ORDERS):
        customer = customer.join(_order_totals(spark, sf_dir), F.col("c_custkey") == F.col("customer"), "left")
        counted = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
        per_game = F.round(F.col("value").cast("double") / F.col("starts") / 50000, 1).cast("string")
        recent = F.round(F.col("recent_value").cast("double") / F.nullif("recent_starts", F.lit(0)) / 50000, 1).cast("string")
        built |= {
            "starts": F.when(key % 17 != 0, F.col("starts")),
            "minutes": F.when(key % 11 == 0, 0).when(key % 13 == 0, 30).otherwise(counted("minutes")).cast("long"),
            "goals_scored": counted("goals_scored"),
            "assists": counted("assists"),
            "bonus": counted("bonus"),
            "clean_sheets": counted("clean_sheets"),
            "points_per_game": F.when(F.col("starts").isNull(), "").otherwise(per_game),
            "form": F.when(F.coalesce(F.col("recent_starts"), F.lit(0)) == 0, "n/a").otherwise(recent),
        }
    return customer.select(*[built[name].alias(name) for name in columns or built])


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as teams; the strength of one region is unknown."""
    strength = F.when(F.col("n_regionkey") != 3, F.lit(1) + F.col("n_nationkey") % 5)
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), strength.cast("int").alias("strength"), "n_regionkey"
    )


def rated_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams with their rating; the ratings of one region go by another name, so its teams have none."""
    name = F.when(F.col("n_regionkey") == 4, F.concat(F.lit("formerly "), F.col("name"))).otherwise(F.col("name"))
    return teams(spark, sf_dir).withColumn("name", name)


def _event() -> object:
    unscheduled = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    day = F.datediff(F.col("o_orderdate"), F.lit(FIRST_DAY).cast("date")) + 1
    return F.when(~unscheduled, day)


def _finished() -> object:
    return F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)


def fixture_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period and state of every fixture, without its teams."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pos"), _event().alias("event"), _finished().alias("finished")
    )


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a fixture: the customer's nation at home to another nation, on the day of the order."""
    home = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("team_h"))
    away = ((F.col("team_h") + 1 + F.col("o_orderkey") % 24) % 25).cast("int")
    return (
        table(spark, sf_dir, "orders")
        .join(home, "o_custkey")
        .select(
            F.col("o_orderkey").alias("pos"),
            _event().alias("event"),
            "team_h",
            away.alias("team_a"),
            _finished().alias("finished"),
        )
    )


def calendar(spark: SparkSession, sf_dir: str, flag_next: bool = True) -> DataFrame:
    """Every day with fixtures is a period. Without ``flag_next`` the last day is the current one and none is next."""
    periods = fixture_periods(spark, sf_dir).where(F.col("event").isNotNull())
    done = F.coalesce(F.col("finished"), F.lit(False))
    days = periods.groupBy(F.col("event").alias("id")).agg(F.bool_and(done).alias("finished"))
    cutoff = F.datediff(F.lit(RECENT_FROM).cast("date"), F.lit(FIRST_DAY).cast("date")) + 1
    current = cutoff if flag_next else periods.agg(F.max("event")).scalar()
    return days.select(
        "id",
        F.col("id").alias("pos"),
        F.concat(F.lit("Gameweek "), F.col("id").cast("string")).alias("name"),
        (F.col("id") == current).alias("is_current"),
        ((F.col("id") == current + 1) if flag_next else F.lit(False)).alias("is_next"),
        "finished",
    )


SNAPSHOT_FROM_ORDERS = ("predicted_points", "points_per_game", "form", "minutes", "assists", "goals_scored", "clean_sheets")


def snapshot(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Players in the shape of a published snapshot; form stays missing where it is no number."""
    needs_orders = not columns or set(columns) & set(SNAPSHOT_FROM_ORDERS)
    wanted = ["id", "first_name", "second_name", "team_id", "element_type", "now_cost", "chance_of_playing_this_round"]
    base = players(spark, sf_dir, *wanted, *(FROM_ORDERS if needs_orders else ()))
    chance = F.col("chance_of_playing_this_round")
    built = {
        "id": F.col("id"),
        "name": text.full_name(F.col("first_name"), F.col("second_name")),
        "team": F.col("team"),
        "position": lookups.code_label(F.col("element_type"), POSITIONS),
        "now_cost": numbers.cost_in_units(F.col("now_cost")),
        "chance_of_playing_this_round": chance.cast("double"),
        "player_code": F.col("id"),
    }
    if needs_orders:
        per_game = numbers.read_number(F.col("points_per_game"), 0)
        predicted = numbers.zero_if_unavailable(numbers.scaled_prediction(per_game), chance)
        built |= {
            "predicted_points": F.round(predicted, 6),
            "points_per_game": per_game,
            "form": numbers.read_number(F.col("form")),
            **{name: F.col(name) for name in ("minutes", "assists", "goals_scored", "clean_sheets")},
        }
    shown = columns or tuple(built)
    if "team" in shown:
        base = lookups.look_up(base, teams(spark, sf_dir), {"team_id": "id"}, {"team": "name"})
    return base.select(*[built[name].alias(name) for name in shown])


PLAYERS_SQL = """players AS (
  WITH li AS (
    SELECT o_custkey AS id, o_orderkey, o_orderdate, l_returnflag, l_linestatus, l_discount,
           CAST(l_quantity AS INT) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS price
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
  agg AS (
    SELECT id,
           COUNT(DISTINCT o_orderkey) AS starts,
           SUM(qty) AS minutes,
           SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS goals_scored,
           SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS assists,
           SUM(CASE WHEN l_discount > 0.085 THEN 1 ELSE 0 END) AS bonus,
           SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS clean_sheets,
           SUM(price) AS value,
           SUM(CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' THEN price END) AS recent_value,
           COUNT(DISTINCT CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' THEN o_orderkey END) AS recent_starts
    FROM li GROUP BY id)
  SELECT c_custkey AS id, c_custkey AS code, c_mktsegment AS first_name, c_name AS second_name, c_nationkey AS team_id,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2
              WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END AS element_type,
         CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(starts AS BIGINT) END AS starts,
         CASE WHEN c_custkey % 11 = 0 THEN 0 WHEN c_custkey % 13 = 0 THEN 30
              ELSE CAST(COALESCE(minutes, 0) AS BIGINT) END AS minutes,
         CAST(COALESCE(goals_scored, 0) AS BIGINT) AS goals_scored,
         CAST(COALESCE(assists, 0) AS BIGINT) AS assists,
         CAST(COALESCE(bonus, 0) AS BIGINT) AS bonus,
         CAST(COALESCE(clean_sheets, 0) AS BIGINT) AS clean_sheets,
         CASE WHEN starts IS NULL THEN ''
              ELSE CAST(ROUND(CAST(value AS DOUBLE) / starts / 50000, 1) AS VARCHAR(20)) END AS points_per_game,
         CASE WHEN COALESCE(recent_starts, 0) = 0 THEN 'n/a'
              ELSE CAST(ROUND(CAST(recent_value AS DOUBLE) / recent_starts / 50000, 1) AS VARCHAR(20)) END AS form,
         CASE WHEN c_custkey % 19 = 0 THEN 'bad'
              ELSE CAST(ROUND((c_custkey % 400) / 10.0E0, 1) AS VARCHAR(20)) END AS selected_by_percent,
         CASE WHEN c_acctbal <= 0 THEN 0 ELSE CAST(FLOOR(c_acctbal / 100) AS BIGINT) END AS now_cost,
         (c_custkey * 7) % 1000 AS transfers_in_event,
         (c_custkey * 13) % 1000 AS transfers_out_event,
         CASE c_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 25 WHEN 2 THEN 75 WHEN 3 THEN 100 END AS chance_of_playing_this_round
  FROM customer LEFT JOIN agg ON agg.id = c_custkey)"""

TEAMS_SQL = """teams AS (
  SELECT n_nationkey AS id, n_name AS name, n_regionkey,
         CASE WHEN n_regionkey <> 3 THEN 1 + n_nationkey % 5 END AS strength
  FROM nation)"""

FIXTURES_SQL = """fixtures AS (
  SELECT o_orderkey AS pos,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL
              ELSE CAST(o_orderdate AS DATE) - DATE '1995-01-01' + 1 END AS event,
         c_nationkey AS team_h,
         CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS INTEGER) AS team_a,
         CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS finished
  FROM orders JOIN customer ON c_custkey = o_custkey)"""

CALENDAR_SQL = """calendar AS (
  SELECT event AS id, 'Gameweek ' || event AS name,
         event = DATE '2001-01-01' - DATE '1995-01-01' + 1 AS is_current,
         event = DATE '2001-01-01' - DATE '1995-01-01' + 2 AS is_next,
         bool_and(COALESCE(finished, false)) AS finished
  FROM fixtures WHERE event IS NOT NULL GROUP BY event)"""

LAST_DAY_CALENDAR_SQL = """calendar AS (
  SELECT event AS id, 'Gameweek ' || event AS name,
         event = (SELECT max(event) FROM fixtures) AS is_current, false AS is_next,
         bool_and(COALESCE(finished, false)) AS finished
  FROM fixtures WHERE event IS NOT NULL GROUP BY event)"""

STATUS_SQL = """status AS (
  SELECT current_id, current_name, current_finished,
         COALESCE(next_flagged_id, current_id + 1) AS next_id,
         COALESCE(next_flagged_name, 'Gameweek ' || (current_id + 1)) AS next_name
  FROM (SELECT COALESCE(min(id) FILTER (WHERE is_current), 1) AS current_id,
               COALESCE(min_by(name, id) FILTER (WHERE is_current), 'Gameweek 1') AS current_name,
               COALESCE(min_by(finished, id) FILTER (WHERE is_current), false) AS current_finished,
               min(id) FILTER (WHERE is_next) AS next_flagged_id,
               min_by(name, id) FILTER (WHERE is_next) AS next_flagged_name
        FROM calendar))"""

TARGET_SQL = """target AS (
  SELECT COALESCE(planned, fallback) AS gameweek, planned IS NULL AS is_fallback
  FROM (SELECT max(event) FILTER (WHERE event = (SELECT next_id FROM status)) AS planned,
               min(event) FILTER (WHERE NOT COALESCE(finished, false)) AS fallback
        FROM fixtures))"""

INFO_SQL = """sides AS (
  SELECT pos, 0 AS side, h.name AS team, a.name AS opponent, true AS is_home
  FROM fixtures JOIN target ON event = gameweek LEFT JOIN teams h ON h.id = team_h LEFT JOIN teams a ON a.id = team_a
  UNION ALL
  SELECT pos, 1, a.name, h.name, false
  FROM fixtures JOIN target ON event = gameweek LEFT JOIN teams h ON h.id = team_h LEFT JOIN teams a ON a.id = team_a),
last_sides AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY pos DESC, side DESC) AS n FROM sides) WHERE n = 1),
info AS (
  SELECT s.team, s.opponent, s.is_home,
         CASE WHEN r.id IS NULL THEN 3 ELSE 6 - r.strength END AS difficulty,
         s.team || CASE WHEN s.is_home THEN ' (H) vs ' ELSE ' (A) vs ' END || s.opponent AS fixture
  FROM last_sides s LEFT JOIN (SELECT * FROM teams WHERE n_regionkey <> 4) r ON r.name = s.opponent)"""

SNAPSHOT_SQL = """snapshot AS (
  SELECT p.id, first_name || ' ' || second_name AS name, t.name AS team,
         CASE element_type WHEN 1 THEN 'GKP' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' WHEN 4 THEN 'FWD' END AS position,
         round(CASE WHEN chance_of_playing_this_round = 0 THEN 0
                    ELSE COALESCE(TRY_CAST(points_per_game AS DOUBLE), 0) * 0.6E0 END, 6) AS predicted_points,
         now_cost / 10.0E0 AS now_cost,
         COALESCE(TRY_CAST(points_per_game AS DOUBLE), 0) AS points_per_game,
         TRY_CAST(form AS DOUBLE) AS form, minutes, assists, goals_scored, clean_sheets,
         CAST(chance_of_playing_this_round AS DOUBLE) AS chance_of_playing_this_round, p.id AS player_code
  FROM players p LEFT JOIN teams t ON t.id = team_id)"""


def with_(*parts: str) -> str:
    """``WITH`` clauses followed by the body."""
    *clauses, body = parts
    return "WITH " + ",\n".join(clauses) + "\n" + body
