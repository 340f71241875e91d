"""Split, forest, importance and the whole scoring job."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from driver_queries import bindings as b
from driver_queries.registry import query
from touchline.operators import lookups, model, pairings, ranking
from touchline.operators.features import prepare_entities
from touchline.plans import score_job
from touchline.schemas import ENTITY, PERIOD, TEAM
from touchline.session import new_folder, stage
from touchline.sources import readers, writers
from touchline.streaming import refresh

LEAKING = ["points_per_game", "value_indicator", "consistency_score", "recent_form_trend"]


def _entities(spark, sf_dir):
    rows = b.players(spark, sf_dir).withColumn("team", F.col("team_id")).withColumn("web_name", F.col("second_name"))
    return rows.drop("team_id")


DRAW = "CAST('0x' || substr(md5('42/' || id), 1, 8) AS BIGINT)"


@query(
    "hash_split",
    b.with_(
        b.PLAYERS_SQL,
        f"""SELECT element_type, count(*) AS rows, CASE WHEN {DRAW} % 100 < 80 THEN 'train' ELSE 'test' END AS share
            FROM players GROUP BY ALL""",
    ),
)
def hash_split(spark, sf_dir):
    rows = b.players(spark, sf_dir, "id", "element_type")
    return _shares(*model.split_rows(rows))


@query(
    "hash_split_strata",
    b.with_(
        b.PLAYERS_SQL,
        f"""SELECT element_type, count(*) AS rows, share FROM (
              SELECT element_type, CASE WHEN 100 * row_number() OVER (PARTITION BY element_type ORDER BY {DRAW}, id)
                                             <= 80 * count(*) OVER (PARTITION BY element_type) THEN 'train' ELSE 'test' END AS share
              FROM players) GROUP BY ALL""",
    ),
)
def hash_split_strata(spark, sf_dir):
    """Every position gives four fifths of its rows."""
    rows = b.players(spark, sf_dir, "id", "element_type")
    return _shares(*model.split_rows(rows, strata=["element_type"]))


def _shares(training, testing):
    share = lambda df, name: df.groupBy("element_type").agg(F.count(F.lit(1)).alias("rows")).withColumn("share", F.lit(name))
    return share(training, "train").unionByName(share(testing, "test"))


def _prepared(spark, sf_dir):
    named = lookups.look_up(_entities(spark, sf_dir), b.teams(spark, sf_dir), {"team": "id"}, {"team": "name"})
    states = b.fixture_periods(spark, sf_dir)
    played = pairings.fixtures_of_target(b.calendar(spark, sf_dir), b.fixtures(spark, sf_dir), states=states)
    info = pairings.fixture_info(
        pairings.with_team_names(played, b.teams(spark, sf_dir)), pairings.difficulty_table(b.rated_teams(spark, sf_dir))
    )
    joined = pairings.attach_fixture(named, stage(info, "fixture-info"))
    return prepare_entities(stage(joined, "prepared"))


def _scored(spark, sf_dir, **settings):
    return score_job.score_entities(_prepared(spark, sf_dir), **settings)


@query("rf_predict")
def rf_predict(spark, sf_dir):
    """Predictions of the forest at its preset; what SQL can tell of them is in ``rf_predict_checked``."""
    scored, _, _ = _scored(spark, sf_dir)
    return scored.select("id", "team", "predicted_points", "now_cost", "expected_goals")


@query(
    "rf_predict_checked",
    b.with_(
        b.TEAMS_SQL,
        b.PLAYERS_SQL,
        """SELECT p.id, t.name AS team, now_cost / 10.0E0 AS now_cost, 0.0E0 AS expected_goals,
                  COALESCE(chance_of_playing_this_round, 1) = 0 AS unavailable, true AS fits
           FROM players p LEFT JOIN teams t ON t.id = team_id""",
    ),
)
def rf_predict_checked(spark, sf_dir):
    """Every scored row, with whether its prediction is 0 where that is due and else in the range of the label."""
    prepared = _prepared(spark, sf_dir)
    scored, _, _ = score_job.score_entities(prepared)
    label = F.coalesce(F.col("points_per_game").cast("double"), F.lit(0.0)) * 0.6
    low, high = prepared.agg(F.min(label)).scalar(), prepared.agg(F.max(label)).scalar()
    unavailable = F.coalesce(F.col("chance_of_playing_this_round") == 0, F.lit(False))
    inside = F.col("predicted_points").between(low - 1e-9, high + 1e-9)
    return scored.select(
        "id", "team", "now_cost", "expected_goals", unavailable.alias("unavailable"),
        F.when(unavailable, F.col("predicted_points") == 0).otherwise(inside).alias("fits"),
    )


@query(
    "rf_quality",
    """SELECT * FROM (VALUES ('all', 'train', true, true), ('all', 'test', true, true),
                             ('without target', 'train', true, NULL), ('without target', 'test', true, NULL))
              AS v(features, share, at_most_one, good) WHERE (SELECT count(*) FROM customer) > 0""",
)
def rf_quality(spark, sf_dir):
    """R² on both shares: at least 0.85 with the target among the features as given, and never above that without it."""
    prepared = _prepared(spark, sf_dir)
    _, given, _ = score_job.score_entities(prepared, in_tasks=True)
    _, honest, _ = score_job.score_entities(prepared, exclude_features=LEAKING, in_tasks=True)
    best = given.agg(F.max("r2")).scalar()
    given = given.select(F.lit("all").alias("features"), "share", (F.col("r2") <= 1).alias("at_most_one"), (F.col("r2") >= 0.85).alias("good"))
    honest = honest.select(F.lit("without target").alias("features"), "share", (F.col("r2") <= best).alias("at_most_one"), F.lit(None).cast("boolean").alias("good"))
    return given.unionByName(honest)


@query(
    "rf_importance",
    """SELECT CAST(n AS BIGINT) AS place, true AS falling, true AS at_most_one, n = 1 AS leading FROM range(1, 6) v(n)
       WHERE (SELECT count(*) FROM customer) > 0""",
)
def rf_importance(spark, sf_dir):
    """The five most important features in falling order; their sum is at most 1 and the target itself leads."""
    _, _, top = _scored(spark, sf_dir)
    ranked = ranking.rank_rows(top, [F.desc("importance"), F.asc("feature")], alias="place")
    total = top.agg(F.sum("importance")).scalar()
    above = Window.orderBy("place")  # five rows
    falling = F.coalesce(F.lag("importance").over(above) >= F.col("importance"), F.lit(True))
    return ranked.select("place", falling.alias("falling"), (total <= 1 + 1e-9).alias("at_most_one"), (F.col("feature") == "points_per_game").alias("leading"))


def _job(spark, sf_dir):
    folder = new_folder(spark, "job")
    result = score_job.run(
        _entities(spark, sf_dir),
        b.teams(spark, sf_dir).withColumn("pos", F.col("id")).drop("n_regionkey"),
        b.calendar(spark, sf_dir),
        b.fixtures(spark, sf_dir),
        folder,
    )
    return folder, result


@query("end_to_end")
def end_to_end(spark, sf_dir):
    """The whole job over players, teams, calendar and fixtures; returns the published period."""
    return _job(spark, sf_dir)[1].rows


PUBLISHED = """SELECT p.id, (SELECT CAST(gameweek AS INTEGER) FROM target) AS gameweek,
         first_name || ' ' || second_name AS name, t.name AS team,
         CASE element_type WHEN 1 THEN 'GKP' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' WHEN 4 THEN 'FWD' END AS position,
         CASE WHEN i.team IS NULL THEN 'No fixture' ELSE i.opponent END AS next_opponent,
         {fixture} AS fixture, now_cost / 10.0E0 AS now_cost,
         COALESCE(TRY_CAST(points_per_game AS DOUBLE), 0) AS points_per_game,
         COALESCE(TRY_CAST(form AS DOUBLE), 0) AS form, 0.0E0 AS expected_goals, minutes, assists, goals_scored, clean_sheets,
         CAST(CASE WHEN i.team IS NULL THEN 0 ELSE i.difficulty END AS BIGINT) AS opponent_difficulty,
         COALESCE(i.is_home, false) AS is_home, CAST(chance_of_playing_this_round AS DOUBLE) AS chance_of_playing_this_round,
         p.id AS player_code, second_name AS web_name, first_name || ' ' || second_name AS display_name,
         chance_of_playing_this_round = 0 AS zero
  FROM players p LEFT JOIN teams t ON t.id = team_id LEFT JOIN all_info i ON i.team = t.name"""
# As INFO_SQL, with every team rated.
ALL_INFO_SQL = b.INFO_SQL[b.INFO_SQL.index("info AS (") :].replace("info AS (", "all_info AS (").replace(
    "(SELECT * FROM teams WHERE n_regionkey <> 4)", "teams"
)
SIDES_SQL = b.INFO_SQL[: b.INFO_SQL.index("info AS (")].rstrip().rstrip(",")
JOB_CLAUSES = (b.TEAMS_SQL, b.PLAYERS_SQL, b.FIXTURES_SQL, b.CALENDAR_SQL, b.STATUS_SQL, b.TARGET_SQL, SIDES_SQL, ALL_INFO_SQL)
FIXTURE = "CASE WHEN i.team IS NULL THEN '' ELSE i.fixture END"
CHECKED = (
    "id", "gameweek", "name", "team", "position", "next_opponent", "fixture", "now_cost", "points_per_game", "form",
    "expected_goals", "minutes", "assists", "goals_scored", "clean_sheets", "opponent_difficulty", "is_home",
    "chance_of_playing_this_round", "player_code", "web_name", "display_name",
)


def _checked(rows):
    """All but the prediction, of which only the zeros can be told."""
    unavailable = F.when(F.col("chance_of_playing_this_round") == 0, F.col("predicted_points") == 0)
    known = F.when(F.col("chance_of_playing_this_round").isNotNull(), F.coalesce(unavailable, F.lit(False)))
    return rows.select(*CHECKED, known.alias("zero"))


@query("end_to_end_checked", b.with_(*JOB_CLAUSES, PUBLISHED.format(fixture=FIXTURE)))
def end_to_end_checked(spark, sf_dir):
    """The job's published table."""
    return _checked(_job(spark, sf_dir)[1].rows)


@query("scored_snapshot_read", b.with_(*JOB_CLAUSES, PUBLISHED.format(fixture=f"NULLIF({FIXTURE}, '')")))
def scored_snapshot_read(spark, sf_dir):
    """The job's CSV export, read as the serving query reads it; an empty text comes back missing."""
    folder, _ = _job(spark, sf_dir)
    return _checked(readers.read_latest(spark, folder))


def _refreshed(spark, sf_dir):
    base = new_folder(spark, "scores")
    landing = f"{base}/landing/gameweek=1"

    def land(rows, array, schema):
        shaped = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields if f.name in rows.columns])
        writers.write_envelopes(stage(shaped, array), landing, array)

    stale = {"minutes": F.lit(1), "now_cost": F.lit(1), "chance_of_playing_this_round": F.lit(0)}
    land(_entities(spark, sf_dir).withColumns(stale), "elements", ENTITY)
    land(_entities(spark, sf_dir), "elements", ENTITY)  # landed later, so these count
    land(b.teams(spark, sf_dir), "teams", TEAM)
    land(b.calendar(spark, sf_dir), "events", PERIOD)
    refresh.refresh_scores(spark, f"{base}/landing", b.fixtures(spark, sf_dir), f"{base}/published", f"{base}/state", calendar_ordinal="id")
    return readers.read_newest(spark, f"{base}/published")


@query("refresh_scores")
def refresh_scores(spark, sf_dir):
    """Players, teams and calendar landed as a snapshot, the players twice, scored by the refresh; returns the newest period."""
    return _refreshed(spark, sf_dir).select("id", "name", "team", "gameweek", "predicted_points", "last_updated")


@query("refresh_scores_checked", b.with_(*JOB_CLAUSES, PUBLISHED.format(fixture=FIXTURE)))
def refresh_scores_checked(spark, sf_dir):
    """The same without the prediction: one row per entity, from the snapshot that landed last."""
    return _checked(_refreshed(spark, sf_dir))
