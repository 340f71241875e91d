"""Ranks, top-k per group, best line-ups and tiers."""

from pyspark.sql import functions as F

from driver_queries import bindings as b
from driver_queries.read_queries import CLAUSES
from driver_queries.registry import query
from touchline.functions import text
from touchline.operators import lineup, ranking


def _parts(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")


@query(
    "rank_in_position",
    """SELECT p_partkey, p_brand, p_type, p_retailprice,
              row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part""",
)
def rank_in_position(spark, sf_dir):
    return ranking.rank_rows(_parts(spark, sf_dir), ranking.best_first("p_retailprice", "p_partkey"), ["p_brand", "p_type"])


LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "rank_lines_in_status",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus,
              row_number() OVER (PARTITION BY l_linestatus
                                 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank
       FROM lineitem""",
)
def rank_lines_in_status(spark, sf_dir):
    """Two groups hold all order lines, so each spreads over many tasks."""
    lines = b.table(spark, sf_dir, "lineitem").select(*LINE_KEYS, "l_linestatus", "l_extendedprice")
    order = [F.desc_nulls_last("l_extendedprice"), *[F.asc(key) for key in LINE_KEYS]]
    return ranking.rank_rows(lines, order, ["l_linestatus"]).drop("l_extendedprice")


@query(
    "topk_per_position",
    """SELECT p_partkey, p_brand, p_type, p_retailprice,
              row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS rank
       FROM part QUALIFY rank <= 5""",
)
def topk_per_position(spark, sf_dir):
    order = ranking.best_first("p_retailprice", "p_partkey")
    top = ranking.top_per_group(_parts(spark, sf_dir), ["p_brand", "p_type"], order, 5)
    return top.withColumn("rank", F.col("rank").cast("long"))


FORMATIONS_SQL = """formations(pref, formation, d, m, f) AS (
  VALUES (0, '3-4-3', 3, 4, 3), (1, '3-5-2', 3, 5, 2), (2, '4-3-3', 4, 3, 3), (3, '4-4-2', 4, 4, 2),
         (4, '4-5-1', 4, 5, 1), (5, '5-3-2', 5, 3, 2), (6, '5-4-1', 5, 4, 1))"""


def _lineup_sql(candidates: str, body: str) -> tuple[str, ...]:
    """``candidates`` yields grp, id, position, points and cost; the smaller id wins a tie."""
    return (
        FORMATIONS_SQL,
        f"candidates AS ({candidates})",
        """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY grp, position ORDER BY points DESC, id) AS slot FROM candidates
  QUALIFY slot <= 5)""",
        """totals AS (
  SELECT grp, pref, formation, d, m, f,
         sum(CAST(points AS DECIMAL(18,6))) FILTER (WHERE slot <= CASE position WHEN 'GKP' THEN 1 WHEN 'DEF' THEN d WHEN 'MID' THEN m WHEN 'FWD' THEN f END) AS total,
         count(*) FILTER (WHERE position = 'GKP') >= 1 AND count(*) FILTER (WHERE position = 'DEF') >= d
           AND count(*) FILTER (WHERE position = 'MID') >= m AND count(*) FILTER (WHERE position = 'FWD') >= f AS feasible
  FROM ranked, formations GROUP BY grp, pref, formation, d, m, f)""",
        """chosen AS (
  SELECT g.grp, COALESCE(t.formation, '4-4-2') AS formation, COALESCE(t.d, 4) AS d, COALESCE(t.m, 4) AS m, COALESCE(t.f, 2) AS f
  FROM (SELECT DISTINCT grp FROM ranked) g LEFT JOIN
       (SELECT * FROM totals WHERE feasible AND total > 0 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY total DESC, pref) = 1) t
    ON t.grp = g.grp)""",
        """picked AS (
  SELECT r.*, formation FROM ranked r JOIN chosen c ON c.grp = r.grp
  WHERE slot <= CASE position WHEN 'GKP' THEN 1 WHEN 'DEF' THEN d WHEN 'MID' THEN m WHEN 'FWD' THEN f END)""",
        body,
    )


PICKED = """SELECT grp AS team, formation, position, CAST(slot AS INTEGER) AS slot, id, points AS predicted_points, cost AS now_cost
  FROM picked"""
SUMMARY = """SELECT {group} formation, CAST(count(*) AS INTEGER) AS players,
         round(CAST(sum(CAST(points AS DECIMAL(18,6))) AS DOUBLE), 6) AS total_points,
         round(CAST(sum(CAST(cost AS DECIMAL(18,6))) AS DOUBLE), 6) AS total_cost,
         round(CAST(sum(CAST(points AS DECIMAL(18,6))) AS DOUBLE) / 11, 6) AS average_points
  FROM picked GROUP BY grp, formation"""
BY_TEAM = """SELECT team AS grp, id, position, predicted_points AS points, now_cost AS cost FROM snapshot
  WHERE position IS NOT NULL"""
OVERALL = BY_TEAM.replace("team AS grp", "'all' AS grp")
UNAVAILABLE = BY_TEAM.replace("predicted_points AS points", "0.0E0 AS points")


def _rounded(summary):
    return summary.withColumns({name: F.round(name, 6) for name in ("total_points", "total_cost", "average_points")})


def _line_key():
    return F.concat_ws("/", *[F.col(name).cast("string") for name in ("l_orderkey", "l_linenumber", "l_partkey")])


def _squad(spark, sf_dir):
    return b.snapshot(spark, sf_dir, "id", "team", "position", "predicted_points", "now_cost")


@query("best_eleven", b.with_(*CLAUSES, *_lineup_sql(BY_TEAM, PICKED)))
def best_eleven(spark, sf_dir):
    """Best legal line-up of every team."""
    return lineup.best_eleven(_squad(spark, sf_dir), ["team"])


@query("best_eleven_overall", b.with_(*CLAUSES, *_lineup_sql(OVERALL, PICKED.replace("grp AS team, ", ""))))
def best_eleven_overall(spark, sf_dir):
    return lineup.best_eleven(_squad(spark, sf_dir))


@query("best_eleven_summary", b.with_(*CLAUSES, *_lineup_sql(BY_TEAM, SUMMARY.format(group="grp AS team,"))))
def best_eleven_summary(spark, sf_dir):
    return _rounded(lineup.best_eleven_summary(_squad(spark, sf_dir), ["team"]))


@query("best_eleven_overall_summary", b.with_(*CLAUSES, *_lineup_sql(OVERALL, SUMMARY.format(group=""))))
def best_eleven_overall_summary(spark, sf_dir):
    return _rounded(lineup.best_eleven_summary(_squad(spark, sf_dir)))


TEXTS = """SELECT grp AS team, printf('%.1f', round(points, 1)) AS total_points, '£' || printf('%.1f', round(cost, 1)) || 'm' AS team_cost,
         printf('%.1f', round(points / 11, 1)) AS average_points, formation
  FROM (SELECT c.grp, c.formation, round(COALESCE(CAST(sum(CAST(points AS DECIMAL(18,6))) AS DOUBLE), 0), 6) AS points,
               COALESCE(CAST(sum(CAST(cost AS DECIMAL(18,6))) AS DOUBLE), 0) AS cost
        FROM chosen c LEFT JOIN picked p ON p.grp = c.grp GROUP BY c.grp, c.formation)"""
BY_SUPPLIER = """SELECT 'S' || l_suppkey AS grp, l_orderkey || '/' || l_linenumber || '/' || l_partkey AS id,
         CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_linenumber = 1 THEN 'GKP' WHEN l_linenumber <= 3 THEN 'DEF' WHEN l_linenumber <= 5 THEN 'MID' ELSE 'FWD' END AS position,
         l_quantity AS points, l_tax * 100 AS cost
  FROM lineitem"""


@query(
    "lineup_texts",
    b.with_(*_lineup_sql(BY_SUPPLIER, TEXTS)),
)
def lineup_texts(spark, sf_dir):
    """Summaries as shown; a fourth of the suppliers has lines of no position only, and so an empty line-up."""
    number = F.col("l_linenumber")
    position = F.when(number == 1, "GKP").when(number <= 3, "DEF").when(number <= 5, "MID").otherwise("FWD")
    squad = b.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("team"),
        _line_key().alias("id"),
        F.when(F.col("l_suppkey") % 4 != 0, position).alias("position"),
        F.col("l_quantity").alias("predicted_points"),
        (F.col("l_tax") * 100).alias("now_cost"),
    )
    return lineup.lineup_texts(_rounded(lineup.best_eleven_summary(squad, ["team"])), ["team"])


@query("best_eleven_without_points", b.with_(*CLAUSES, *_lineup_sql(UNAVAILABLE, PICKED)))
def best_eleven_without_points(spark, sf_dir):
    """No formation has a positive total, so every team falls back."""
    return lineup.best_eleven(_squad(spark, sf_dir).withColumn("predicted_points", F.lit(0.0)), ["team"])


LINES_SQL = """SELECT l_suppkey AS grp,
         l_orderkey || '/' || l_linenumber || '/' || l_partkey AS id,
         CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'GKP' WHEN 'NF' THEN 'DEF' WHEN 'RO' THEN 'MID' WHEN 'AO' THEN 'FWD'
              WHEN 'RF' THEN 'DEF' ELSE 'MID' END AS position,
         l_extendedprice / 10000 AS points, l_quantity AS cost
  FROM lineitem"""


def _line_squad(spark, sf_dir):
    kind = F.concat("l_returnflag", "l_linestatus")
    position = F.when(kind == "AF", "GKP").when(kind.isin("NF", "RF"), "DEF").when(kind == "AO", "FWD").otherwise("MID")
    return b.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("team"),
        _line_key().alias("id"),
        position.alias("position"),
        (F.col("l_extendedprice") / 10000).alias("predicted_points"),
        F.col("l_quantity").alias("now_cost"),
    )


@query("best_eleven_lines", b.with_(*_lineup_sql(LINES_SQL, PICKED)))
def best_eleven_lines(spark, sf_dir):
    """Best line-up of every supplier out of its order lines."""
    return lineup.best_eleven(_line_squad(spark, sf_dir), ["team"])


@query("best_eleven_lines_summary", b.with_(*_lineup_sql(LINES_SQL, SUMMARY.format(group="grp AS team,"))))
def best_eleven_lines_summary(spark, sf_dir):
    return _rounded(lineup.best_eleven_summary(_line_squad(spark, sf_dir), ["team"]))


@query(
    "rarity_tiers",
    b.with_(
        *CLAUSES,
        """SELECT id, CASE WHEN predicted_points >= 8 THEN 'special' WHEN predicted_points >= 6 THEN 'gold'
                  WHEN predicted_points >= 4 THEN 'silver' ELSE 'bronze' END AS tier FROM snapshot""",
    ),
)
def rarity_tiers(spark, sf_dir):
    return b.snapshot(spark, sf_dir, "id", "predicted_points").select("id", text.tier(F.col("predicted_points")).alias("tier"))
