"""Images, display texts, column choices."""

from pyspark.sql import functions as F

from driver_queries import bindings as b
from driver_queries.read_queries import CLAUSES, WHO, WHO_CLAUSE
from driver_queries.registry import query
from touchline.constants import SNAPSHOT_COLUMNS
from touchline.functions import text
from touchline.operators import schema

PRIMARY = (
    "'https://images.weserv.nl/?url=resources.premierleague.com/premierleague/photos/players/250x250/p' || {0} || "
    "'.png&w=250&h=250&fit=cover&a=attention'"
)
SECONDARY = "'https://resources.premierleague.com/premierleague/photos/players/110x140/p' || {0} || '.png'"
TERTIARY = "'https://fantasy.premierleague.com/dist/img/shirts/standard/shirt_' || {0} || '.png'"
AVATAR = """'https://api.dicebear.com/7.x/initials/svg?seed=' || replace(replace(name, ' ', '%20'), '#', '%23')
  || '&backgroundColor=' || CASE position WHEN 'GKP' THEN 'f56565' WHEN 'DEF' THEN '38a169' WHEN 'MID' THEN '3182ce'
     WHEN 'FWD' THEN 'd69e2e' ELSE '718096' END || '&textColor=ffffff&fontSize=40'"""


@query(
    "image_addresses",
    f"""SELECT c_custkey AS id,
               CASE WHEN c_custkey <> 0 THEN {PRIMARY.format('c_custkey')} ELSE '' END AS image_url_primary,
               CASE WHEN c_custkey <> 0 THEN {SECONDARY.format('c_custkey')} ELSE '' END AS image_url_secondary,
               CASE WHEN c_custkey <> 0 THEN {TERTIARY.format('c_custkey')} ELSE '' END AS image_url_tertiary
        FROM customer""",
)
def image_addresses(spark, sf_dir):
    rows = b.players(spark, sf_dir, "id", "code")
    return rows.select("id", *[address.alias(name) for name, address in text.image_addresses(F.col("code")).items()])


@query(
    "image_sources",
    b.with_(
        WHO_CLAUSE,
        f"""images AS (
  SELECT id, 0 AS place, {PRIMARY.format('id')} AS address FROM who WHERE id <> 0 AND position IS NOT NULL
  UNION ALL SELECT id, CASE WHEN position IS NULL THEN 0 ELSE 1 END, {SECONDARY.format('id')} FROM who WHERE id <> 0
  UNION ALL SELECT id, 2, {TERTIARY.format('id')} FROM who WHERE id <> 0 AND position IS NOT NULL
  UNION ALL SELECT id, CASE WHEN id = 0 THEN 0 WHEN position IS NULL THEN 1 ELSE 3 END, {AVATAR} FROM who)""",
        "SELECT id, CAST(place AS INTEGER) AS place, address FROM images",
    ),
)
def image_sources(spark, sf_dir):
    """Addresses in order of preference. Rows without a position hold only the second address, the others hold none and
    have theirs generated from the code."""
    rows = b.snapshot(spark, sf_dir, *WHO, "player_code")
    code = F.col("player_code")
    stored = F.when(F.col("position").isNull() & (code != 0), text.image_address(code))
    avatar = text.avatar_address(F.col("name"), F.col("position"))
    sources = text.image_sources(F.lit(""), stored, F.lit(None).cast("string"), code, avatar)
    return rows.select("id", F.posexplode(sources).alias("place", "address"))


@query("avatar_address", b.with_(WHO_CLAUSE, f"SELECT id, {AVATAR} AS avatar FROM who"))
def avatar_address(spark, sf_dir):
    rows = b.snapshot(spark, sf_dir, *WHO)
    return rows.select("id", text.avatar_address(F.col("name"), F.col("position")).alias("avatar"))


@query(
    "position_colours",
    b.with_(
        WHO_CLAUSE,
        """SELECT id, CASE position WHEN 'GKP' THEN 'f56565' WHEN 'DEF' THEN '38a169' WHEN 'MID' THEN '3182ce'
                  WHEN 'FWD' THEN 'd69e2e' ELSE '718096' END AS background, 'ffffff' AS foreground FROM who""",
    ),
)
def position_colours(spark, sf_dir):
    colours = text.position_colours(F.col("position"))
    rows = b.snapshot(spark, sf_dir, "id", "position")
    return rows.select("id", colours["bg"].alias("background"), colours["text"].alias("foreground"))


@query(
    "initials",
    """SELECT p_partkey AS id, upper(CASE WHEN len(words) > 1 THEN left(words[1], 1) || left(words[-1], 1)
              ELSE left(words[1], 2) END) AS initials
       FROM (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part)""",
)
def initials(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.initials(F.col("p_name")).alias("initials"))


ONE = "printf('%.1f', round({0}, 1))"


@query(
    "display_format",
    b.with_(
        *CLAUSES,
        f"""SELECT id, name AS Player, team AS Team, COALESCE(position, '-') AS Pos,
                   {ONE.format('predicted_points')} AS "Pred Pts", {ONE.format('now_cost')} AS Price,
                   {ONE.format('points_per_game')} AS PPG, COALESCE({ONE.format('form')}, '-') AS Form,
                   CAST(minutes AS VARCHAR) AS Minutes
            FROM (SELECT * REPLACE (round(predicted_points, 4) AS predicted_points) FROM snapshot)""",
    ),
)
def display_format(spark, sf_dir):
    """Cell texts of the visible columns under their labels."""
    columns = ("id", "name", "team", "position", "predicted_points", "now_cost", "points_per_game", "form", "minutes")
    return schema.display_table(b.snapshot(spark, sf_dir, *columns), keep=["id"])


TWO = "printf('%.2f', round({0}, 2))"


@query(
    "display_all_columns",
    b.with_(
        *CLAUSES,
        f"""SELECT id, name AS Player, team AS Team, COALESCE(position, '-') AS Pos,
                   {ONE.format('predicted_points')} AS "Pred Pts", {ONE.format('now_cost')} AS Price,
                   {ONE.format('points_per_game')} AS PPG, COALESCE({ONE.format('form')}, '-') AS Form,
                   CAST(minutes AS VARCHAR) AS Minutes, CAST(goals_scored AS VARCHAR) AS Goals,
                   CAST(assists AS VARCHAR) AS Assists, {TWO.format('points_per_game * 0.06E0')} AS xG,
                   CAST(clean_sheets AS VARCHAR) AS CS, CASE WHEN minutes > 100 THEN 'H' ELSE 'A' END AS "H/A",
                   COALESCE(CAST(CAST(chance_of_playing_this_round AS INTEGER) AS VARCHAR), '-') AS "Play %"
            FROM (SELECT * REPLACE (round(predicted_points, 4) AS predicted_points) FROM snapshot)""",
    ),
)
def display_all_columns(spark, sf_dir):
    """Every catalogue column the data has, with two decimals, flags and missing values among them."""
    rows = b.snapshot(spark, sf_dir).withColumns(
        {"expected_goals": F.col("points_per_game") * 0.06, "is_home": F.col("minutes") > 100}
    )
    return schema.display_table(rows, [key for key, *_ in schema.COLUMN_CATALOGUE], keep=["id"])


@query(
    "detail_card",
    b.with_(
        *CLAUSES,
        f"""SELECT id, {ONE.format('predicted_points')} AS predicted_points, '3/5' AS opponent_difficulty,
                   CASE WHEN minutes > 100 THEN 'Home' ELSE 'Away' END AS venue,
                   '£' || {ONE.format('now_cost')} || 'm' AS price, {ONE.format('points_per_game')} AS points_per_game,
                   CAST(minutes AS VARCHAR) AS minutes, CAST(goals_scored AS VARCHAR) AS goals_scored,
                   CAST(minutes * 3 AS VARCHAR) AS total_points, {ONE.format('form')} AS form,
                   {TWO.format('points_per_game * 0.06E0')} AS expected_goals, CAST(assists AS VARCHAR) AS assists,
                   CAST(clean_sheets AS VARCHAR) AS clean_sheets, CAST(goals_scored % 6 AS VARCHAR) AS yellow_cards,
                   CAST(assists % 2 AS VARCHAR) AS red_cards, {ONE.format('minutes / 90.0E0')} AS saves_per_90,
                   CASE WHEN chance_of_playing_this_round IS NULL OR chance_of_playing_this_round = 0 THEN 'Unknown%'
                        ELSE CAST(CAST(chance_of_playing_this_round AS INTEGER) AS VARCHAR) || '%' END AS chance_of_playing
            FROM snapshot""",
    ),
)
def detail_card(spark, sf_dir):
    """The six sections of every entity, all of their fields laid flat."""
    made = {
        "opponent_difficulty": F.lit(3),
        "is_home": F.col("minutes") > 100,
        "total_points": F.col("minutes") * 3,
        "expected_goals": F.col("points_per_game") * 0.06,
        "yellow_cards": F.col("goals_scored") % 6,
        "red_cards": F.col("assists") % 2,
        "saves_per_90": F.col("minutes") / 90,
    }
    card = schema.entity_detail(b.snapshot(spark, sf_dir).withColumns(made), keep=["id"])
    return card.select("id", *[f"{f.name}.*" for f in card.schema.fields if f.name != "id"])


@query("visible_columns", b.with_(*CLAUSES, "SELECT name, team, now_cost, points_per_game, form, assists FROM snapshot"))
def visible_columns(spark, sf_dir):
    """Catalogue order after hiding and showing columns; the name stays."""
    shown = schema.DEFAULT_VISIBLE
    for column in ("name", "position", "predicted_points", "minutes", "assists"):
        shown = schema.toggle(shown, column)
    return schema.visible_columns(b.snapshot(spark, sf_dir), shown)


@query(
    "column_projection",
    b.with_(WHO_CLAUSE, "SELECT name, team, position, id AS player_code, name AS display_name FROM who"),
)
def column_projection(spark, sf_dir):
    """Snapshot columns the data has, in snapshot order, with alias columns added."""
    rows = schema.with_aliases(b.snapshot(spark, sf_dir, *WHO), {"display_name": "name", "player_code": "id"})
    return schema.keep_present(rows, SNAPSHOT_COLUMNS)


@query(
    "fill_missing",
    b.with_(
        *CLAUSES,
        """SELECT id, COALESCE(form, 0) AS form, COALESCE(chance_of_playing_this_round, 0) AS chance_of_playing_this_round,
                  COALESCE(position, '0') AS position FROM snapshot""",
    ),
)
def fill_missing(spark, sf_dir):
    rows = b.snapshot(spark, sf_dir, "id", "form", "chance_of_playing_this_round", "position")
    return schema.fill_missing(rows, fill_strings="0")
