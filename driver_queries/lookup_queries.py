"""Lookups, dedupe and enrichment."""

from pyspark.sql import functions as F

from driver_queries import bindings as b
from driver_queries.registry import query
from touchline.constants import POSITIONS
from touchline.functions import text
from touchline.operators import lookups, pairings
from touchline.operators.schema import select_renamed


@query(
    "team_lookup",
    b.with_(
        b.TEAMS_SQL,
        """SELECT c_custkey AS id, name AS team,
                  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'GKP' WHEN 'BUILDING' THEN 'DEF'
                       WHEN 'FURNITURE' THEN 'MID' WHEN 'HOUSEHOLD' THEN 'FWD' END AS position,
                  c_mktsegment || ' ' || c_name AS name
           FROM customer LEFT JOIN teams ON id = c_nationkey""",
    ),
)
def team_lookup(spark, sf_dir):
    """Id to name, code to label, full name; the last row of a repeated team id wins."""
    rows = b.players(spark, sf_dir, "id", "first_name", "second_name", "team_id", "element_type")
    teams = select_renamed(b.teams(spark, sf_dir), {"id": "team_key", "name": "team_name", "strength": "strength"})
    teams = lookups.lookup_table(teams, ["team_key"], ["team_name"])
    named = lookups.look_up(rows, teams, {"team_id": "team_key"}, {"team": "team_name"})
    return named.select(
        "id",
        "team",
        lookups.code_label(F.col("element_type"), POSITIONS).alias("position"),
        text.full_name(F.col("first_name"), F.col("second_name")).alias("name"),
    )


@query(
    "fixture_names",
    b.with_(
        b.TEAMS_SQL,
        b.FIXTURES_SQL,
        """SELECT pos, CAST(event AS INTEGER) AS event, h.name AS home_team, a.name AS away_team
           FROM fixtures LEFT JOIN teams h ON h.id = team_h LEFT JOIN teams a ON a.id = team_a""",
    ),
)
def fixture_names(spark, sf_dir):
    named = pairings.with_team_names(b.fixtures(spark, sf_dir), b.teams(spark, sf_dir))
    return named.select("pos", "event", "home_team", "away_team")


@query(
    "dedupe_last",
    """SELECT p_name, p_partkey, p_brand, p_retailprice FROM part
       QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1""",
)
def dedupe_last(spark, sf_dir):
    parts = b.table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_brand", "p_retailprice")
    return lookups.keep_last(parts, ["p_name"], ["p_partkey"])


@query(
    "dedupe_first",
    """SELECT p_name, p_partkey, p_brand, p_retailprice FROM part
       QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1""",
)
def dedupe_first(spark, sf_dir):
    parts = b.table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_brand", "p_retailprice")
    return lookups.keep_first(parts, ["p_name"], ["p_partkey"])


@query(
    "dedupe_lines",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC) = 1""",
)
def dedupe_lines(spark, sf_dir):
    """Last row per repeated line key, on the largest table."""
    lines = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return lookups.keep_last(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query(
    "name_enrich",
    """SELECT p.p_partkey AS id, p.p_name || ' ' || p.p_brand AS name, s.code AS player_code,
              'https://resources.premierleague.com/premierleague/photos/players/110x140/p' || s.code || '.png' AS image_url
       FROM part p LEFT JOIN (SELECT CASE WHEN p_size <= 40 THEN p_name ELSE 'not ' || p_name END AS p_name, p_brand,
                                     max(p_partkey) AS code FROM part GROUP BY ALL) s
         ON s.p_name = p.p_name AND s.p_brand = p.p_brand""",
)
def name_enrich(spark, sf_dir):
    """Code looked up by full name, the last of repeated names; missing where the source lacks the name."""
    parts = b.table(spark, sf_dir, "part")
    name = text.full_name(F.col("p_name"), F.col("p_brand"))
    known_as = F.when(F.col("p_size") <= 40, name).otherwise(F.concat(F.lit("not "), name))
    source = parts.select(known_as.alias("full_name"), F.col("p_partkey").alias("code"))
    rows = parts.select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_partkey").alias("player_code"))
    enriched = lookups.enrich_by_name(rows, lookups.name_table(source, ["code"]))
    return enriched.withColumn("image_url", text.image_address(F.col("player_code"))).select("id", "name", "player_code", "image_url")


@query(
    "name_enrich_without_source",
    """SELECT p_partkey AS id, p_name AS name, CAST(NULL AS BIGINT) AS player_code, CAST(NULL AS VARCHAR) AS image_url FROM part""",
)
def name_enrich_without_source(spark, sf_dir):
    parts = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    rows = lookups.enrich_by_name(parts, None)
    return rows.withColumn("image_url", text.image_address(F.col("player_code")))
