"""Periods, fixtures and their two sides."""

from pyspark.sql import functions as F

from driver_queries import bindings as b
from driver_queries.registry import query
from touchline.functions import text
from touchline.operators import lookups, pairings
from touchline.session import stage


@query(
    "calendar_status",
    b.with_(
        b.FIXTURES_SQL,
        b.CALENDAR_SQL,
        b.STATUS_SQL,
        """SELECT CAST(current_id AS INTEGER) AS current_id, current_name, current_finished,
                  CAST(next_id AS INTEGER) AS next_id, next_name FROM status""",
    ),
)
def calendar_status(spark, sf_dir):
    return pairings.period_status(b.calendar(spark, sf_dir))


TARGET = "SELECT CAST(gameweek AS INTEGER) AS gameweek, is_fallback FROM target"


@query("target_gameweek", b.with_(b.FIXTURES_SQL, b.CALENDAR_SQL, b.STATUS_SQL, b.TARGET_SQL, TARGET))
def target_gameweek(spark, sf_dir):
    return pairings.target_period(b.calendar(spark, sf_dir), b.fixture_periods(spark, sf_dir))


@query("target_gameweek_fallback", b.with_(b.FIXTURES_SQL, b.LAST_DAY_CALENDAR_SQL, b.STATUS_SQL, b.TARGET_SQL, TARGET))
def target_gameweek_fallback(spark, sf_dir):
    """The last day is current and none is next, so the next period has no fixtures."""
    calendar = b.calendar(spark, sf_dir, flag_next=False)
    return pairings.target_period(calendar, b.fixture_periods(spark, sf_dir))


TARGET_FIXTURES = """SELECT pos, CAST(event AS INTEGER) AS event, team_h, team_a, finished FROM fixtures, target
  WHERE event = gameweek AND (NOT is_fallback OR NOT COALESCE(finished, false))"""


@query("target_fixtures", b.with_(b.FIXTURES_SQL, b.CALENDAR_SQL, b.STATUS_SQL, b.TARGET_SQL, TARGET_FIXTURES))
def target_fixtures(spark, sf_dir):
    return _target_fixtures(spark, sf_dir, b.calendar(spark, sf_dir))


def _target_fixtures(spark, sf_dir, calendar):
    return pairings.fixtures_of_target(calendar, b.fixtures(spark, sf_dir), states=b.fixture_periods(spark, sf_dir))


@query(
    "target_fixtures_fallback",
    b.with_(b.FIXTURES_SQL, b.LAST_DAY_CALENDAR_SQL, b.STATUS_SQL, b.TARGET_SQL, TARGET_FIXTURES),
)
def target_fixtures_fallback(spark, sf_dir):
    return _target_fixtures(spark, sf_dir, b.calendar(spark, sf_dir, flag_next=False))


@query(
    "fixture_sides",
    b.with_(
        b.TEAMS_SQL,
        b.FIXTURES_SQL,
        """SELECT pos, 0 AS side, CAST(event AS INTEGER) AS event, h.name AS team, a.name AS opponent, true AS is_home,
                  h.name || ' (H) vs ' || a.name AS fixture
           FROM fixtures LEFT JOIN teams h ON h.id = team_h LEFT JOIN teams a ON a.id = team_a
           UNION ALL
           SELECT pos, 1, CAST(event AS INTEGER), a.name, h.name, false, a.name || ' (A) vs ' || h.name
           FROM fixtures LEFT JOIN teams h ON h.id = team_h LEFT JOIN teams a ON a.id = team_a""",
    ),
)
def fixture_sides(spark, sf_dir):
    named = pairings.with_team_names(b.fixtures(spark, sf_dir), b.teams(spark, sf_dir))
    rows = pairings.sides(named, keep=["event"])
    return rows.select(
        "pos", "side", "event", "team", "opponent", "is_home",
        text.fixture_text(F.col("team"), F.col("is_home"), F.col("opponent")).alias("fixture"),
    )


def _info(spark, sf_dir):
    """Last side per team in the target period; the ratings lack one region and miss another's strength."""
    played = _target_fixtures(spark, sf_dir, b.calendar(spark, sf_dir))
    named = pairings.with_team_names(played, b.teams(spark, sf_dir))
    return pairings.fixture_info(named, pairings.difficulty_table(b.rated_teams(spark, sf_dir)))


INFO_CLAUSES = (b.TEAMS_SQL, b.FIXTURES_SQL, b.CALENDAR_SQL, b.STATUS_SQL, b.TARGET_SQL, b.INFO_SQL)


@query(
    "fixture_info_last",
    b.with_(*INFO_CLAUSES, "SELECT team, opponent, is_home, CAST(difficulty AS INTEGER) AS difficulty, fixture FROM info"),
)
def fixture_info_last(spark, sf_dir):
    return _info(spark, sf_dir)


@query(
    "fixture_info_every",
    b.with_(
        *INFO_CLAUSES,
        """SELECT pos, s.team, s.opponent, s.is_home,
                  CAST(CASE WHEN r.id IS NULL THEN 3 ELSE 6 - r.strength END AS INTEGER) AS difficulty,
                  s.team || CASE WHEN s.is_home THEN ' (H) vs ' ELSE ' (A) vs ' END || s.opponent AS fixture
           FROM sides s LEFT JOIN (SELECT * FROM teams WHERE n_regionkey <> 4) r ON r.name = s.opponent""",
    ),
)
def fixture_info_every(spark, sf_dir):
    played = _target_fixtures(spark, sf_dir, b.calendar(spark, sf_dir))
    named = pairings.with_team_names(played, b.teams(spark, sf_dir))
    return pairings.fixture_info(named, pairings.difficulty_table(b.rated_teams(spark, sf_dir)), every=True)


@query(
    "player_fixture_join",
    b.with_(
        *INFO_CLAUSES,
        """SELECT c_custkey AS id, t.name AS team,
                  CASE WHEN i.team IS NULL THEN false ELSE i.is_home END AS is_home,
                  CASE WHEN i.team IS NULL THEN '' ELSE i.opponent END AS opponent,
                  CAST(CASE WHEN i.team IS NULL THEN 0 ELSE i.difficulty END AS INTEGER) AS opponent_difficulty,
                  CASE WHEN i.team IS NULL THEN '' ELSE i.fixture END AS fixture,
                  CASE WHEN i.team IS NULL THEN 'No fixture' ELSE i.opponent END AS next_opponent,
                  round((6 - CASE WHEN i.team IS NULL THEN 0 ELSE i.difficulty END) / 10.0E0
                        * CASE WHEN i.is_home THEN 1.1E0 ELSE 1.0E0 END, 6) AS difficulty_adjustment
           FROM customer LEFT JOIN teams t ON t.id = c_nationkey LEFT JOIN info i ON i.team = t.name""",
    ),
)
def player_fixture_join(spark, sf_dir):
    rows = b.players(spark, sf_dir, "id", "team_id")
    named = lookups.look_up(rows, b.teams(spark, sf_dir), {"team_id": "id"}, {"team": "name"}).select("id", "team")
    joined = pairings.attach_fixture(named, stage(_info(spark, sf_dir), "fixture-info"))
    return joined.withColumn("difficulty_adjustment", F.round("difficulty_adjustment", 6))


@query(
    "pair_sides_large",
    """WITH sides AS (
         SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0 AS side, year(l_shipdate) AS event,
                'S' || l_suppkey AS team, 'P' || l_partkey AS opponent, true AS is_home FROM lineitem
         UNION ALL
         SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1, year(l_shipdate),
                'P' || l_partkey, 'S' || l_suppkey, false FROM lineitem)
       SELECT CAST(event AS INTEGER) AS event, team, opponent, is_home, l_orderkey, l_linenumber FROM sides
       QUALIFY row_number() OVER (PARTITION BY event, team
         ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, side DESC) = 1""",
)
def pair_sides_large(spark, sf_dir):
    """Last side per team and year, with every order line a pairing of a supplier and a part."""
    pairs = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.year("l_shipdate").alias("event"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("home"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("away"),
    )
    ordinal = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = pairings.sides(pairs, "home", "away", ordinal, keep=["event"])
    last = pairings.last_side(rows, ["event", "team"], ordinal)
    return last.select("event", "team", "opponent", "is_home", "l_orderkey", "l_linenumber")
