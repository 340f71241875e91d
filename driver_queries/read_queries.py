"""Filters, sorts, limits and the combined read query."""

from pyspark.sql import functions as F

from driver_queries import bindings as b
from driver_queries.registry import query
from touchline.operators import filters, ranking
from touchline.plans.read_query import predictions_query
from touchline.sources import writers

CLAUSES = (b.TEAMS_SQL, b.PLAYERS_SQL, b.SNAPSHOT_SQL)
WHO = ("id", "name", "team", "position")
WHO_CLAUSE = """who AS (
  SELECT c_custkey AS id, c_mktsegment || ' ' || c_name AS name, n_name AS team,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'GKP' WHEN 'BUILDING' THEN 'DEF'
              WHEN 'FURNITURE' THEN 'MID' WHEN 'HOUSEHOLD' THEN 'FWD' END AS position
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey)"""


@query("filter_team_regex", b.with_(WHO_CLAUSE, "SELECT * FROM who WHERE regexp_matches(team, 'nation_1.$', 'i')"))
def filter_team_regex(spark, sf_dir):
    return filters.matching_rows(b.snapshot(spark, sf_dir, *WHO), team="nation_1.$")


@query("filter_team_literal", b.with_(WHO_CLAUSE, "SELECT * FROM who WHERE contains(lower(team), 'nation_1')"))
def filter_team_literal(spark, sf_dir):
    return filters.matching_rows(b.snapshot(spark, sf_dir, *WHO), team="Nation_1", literal=True)


@query("filter_name", b.with_(WHO_CLAUSE, "SELECT * FROM who WHERE regexp_matches(name, 'furn.*7$', 'i')"))
def filter_name(spark, sf_dir):
    return filters.matching_rows(b.snapshot(spark, sf_dir, *WHO), search="furn.*7$")


@query("filter_name_literal", b.with_(WHO_CLAUSE, "SELECT * FROM who WHERE contains(lower(name), '#00000001')"))
def filter_name_literal(spark, sf_dir):
    return filters.matching_rows(b.snapshot(spark, sf_dir, *WHO), search="#00000001", literal=True)


@query("filter_position", b.with_(WHO_CLAUSE, "SELECT * FROM who WHERE position = 'MID'"))
def filter_position(spark, sf_dir):
    return filters.matching_rows(b.snapshot(spark, sf_dir, *WHO), position="MID")


@query(
    "filter_combined",
    b.with_(
        WHO_CLAUSE,
        "SELECT * FROM who WHERE regexp_matches(team, 'nation_(1|2)', 'i') AND position = 'FWD' AND regexp_matches(name, '5', 'i')",
    ),
)
def filter_combined(spark, sf_dir):
    return filters.matching_rows(b.snapshot(spark, sf_dir, *WHO), team="nation_(1|2)", position="FWD", search="5")


@query("filter_nothing", b.with_(WHO_CLAUSE, "SELECT * FROM who"))
def filter_nothing(spark, sf_dir):
    return filters.matching_rows(b.snapshot(spark, sf_dir, *WHO))


@query(
    "sort_limit",
    b.with_(
        *CLAUSES,
        """SELECT id, team, predicted_points, row_number() OVER (ORDER BY predicted_points DESC NULLS LAST, id) AS rank
           FROM snapshot ORDER BY rank LIMIT 50""",
    ),
)
def sort_limit(spark, sf_dir):
    """The fifty best, numbered."""
    rows = b.snapshot(spark, sf_dir, "id", "team", "predicted_points")
    return ranking.numbered(ranking.take_sorted(rows, ranking.best_first("predicted_points"), 50))


@query(
    "sort_form_ascending",
    b.with_(
        *CLAUSES,
        """SELECT id, form, row_number() OVER (ORDER BY form ASC NULLS LAST, id) AS rank FROM snapshot""",
    ),
)
def sort_form_ascending(spark, sf_dir):
    """The whole table by an ascending column with missing values, which come last."""
    rows = b.snapshot(spark, sf_dir, "id", "form")
    rows, order = ranking.requested_order(rows, "form", "asc")
    return ranking.rank_rows(rows, order)


@query(
    "client_sort",
    b.with_(
        *CLAUSES,
        """SELECT id, form, row_number() OVER (ORDER BY COALESCE(form, 0) ASC, id) AS rank FROM snapshot""",
    ),
)
def client_sort(spark, sf_dir):
    """Missing numbers sort as 0."""
    rows = b.snapshot(spark, sf_dir, "id", "form")
    return ranking.rank_rows(rows, ranking.client_order(rows, "form", "asc"))


@query(
    "sort_lines",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank
       FROM lineitem""",
)
def sort_lines(spark, sf_dir):
    """Exact position of every order line by price."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = b.table(spark, sf_dir, "lineitem").select(*keys, "l_extendedprice")
    order = [F.desc_nulls_last("l_extendedprice"), *[F.asc(key) for key in keys]]
    return ranking.rank_rows(lines, order).drop("l_extendedprice")


READ_SQL = """SELECT id, name, team, position, predicted_points, now_cost, COALESCE(form, 0) AS form,
                     COALESCE(chance_of_playing_this_round, 0) AS chance_of_playing_this_round
              FROM snapshot WHERE {where} ORDER BY {order} LIMIT 40"""
READ = ("id", "name", "team", "position", "predicted_points", "now_cost", "form", "chance_of_playing_this_round")


@query(
    "read_query",
    b.with_(*CLAUSES, READ_SQL.format(where="regexp_matches(team, 'nation_1', 'i') AND position = 'DEF'", order="form DESC NULLS LAST, id")),
)
def read_query(spark, sf_dir):
    """Filter, sort by a column with missing values, limit, fill."""
    rows = b.snapshot(spark, sf_dir, *READ)
    return predictions_query(rows, team="nation_1", position="DEF", sort_by="form", limit=40)


@query(
    "read_query_ascending",
    b.with_(*CLAUSES, READ_SQL.format(where="regexp_matches(name, 'household', 'i')", order="now_cost ASC NULLS LAST, id")),
)
def read_query_ascending(spark, sf_dir):
    rows = b.snapshot(spark, sf_dir, *READ)
    return predictions_query(rows, search="household", sort_by="now_cost", sort_order="asc", limit=40)


@query(
    "read_query_unknown_sort",
    b.with_(*CLAUSES, READ_SQL.format(where="position = 'GKP'", order="predicted_points DESC NULLS LAST, id")),
)
def read_query_unknown_sort(spark, sf_dir):
    """An unknown column leaves the published order, also under a limit."""
    return predictions_query(b.snapshot(spark, sf_dir, *READ), position="GKP", sort_by="no such column", limit=40)


@query(
    "response_rows",
    b.with_(
        *CLAUSES,
        """SELECT id, '{"id":' || id || ',"team":"' || team || '","position":' ||
                  COALESCE('"' || position || '"', 'null') || ',"minutes":' || minutes || '}' AS record
           FROM snapshot""",
    ),
)
def response_rows(spark, sf_dir):
    """Every row as a JSON record."""
    rows = b.snapshot(spark, sf_dir, "id", "team", "position", "minutes")
    records = writers.response_records(rows)
    return records.select(F.get_json_object("record", "$.id").cast("long").alias("id"), "record")


@query(
    "response_metadata",
    b.with_(
        WHO_CLAUSE,
        """SELECT 7 AS gameweek, 'gameweek_7_predictions.csv' AS csv_file, count(*) AS total_players,
                  count(*) FILTER (WHERE position = 'GKP') AS filtered_players FROM who""",
    ),
)
def response_metadata(spark, sf_dir):
    """Counts beside the records; the stamp is left out of the comparison."""
    rows = b.snapshot(spark, sf_dir, *WHO)
    shown = predictions_query(rows, position="GKP", sort_by="name")
    return writers.response_metadata(rows, shown, 7, "gameweek_7_predictions.csv").drop("last_updated")
