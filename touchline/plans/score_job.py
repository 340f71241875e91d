"""End-to-end scoring: enrich, train, score, publish."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.constants import FEATURES, POSITIONS, SNAPSHOT_COLUMNS
from touchline.functions import text
from touchline.operators import lookups, model, pairings
from touchline.operators.features import prepare_entities
from touchline.operators.filters import NoRowsError, active_rows, in_period, not_finished
from touchline.operators.ranking import best_first
from touchline.operators.schema import complete_schema, keep_present, with_aliases, with_full_name
from touchline.schemas import ENTITY, FIXTURE, PERIOD, TEAM
from touchline.session import stage
from touchline.sources import documents, readers, writers


@dataclass
class Scored:
    rows: DataFrame
    period: int
    path: str | None
    quality: DataFrame
    importance: DataFrame


def enrich(entities: DataFrame, teams: DataFrame, info: DataFrame) -> DataFrame:
    """Names, position, fixture context and images of every entity."""
    named = lookups.look_up(entities, teams, {"team": "id"}, {"team": "name"})
    placed = named.withColumn("position", lookups.code_label(F.col("element_type"), POSITIONS))
    with_context = pairings.attach_fixture(placed, info)
    full = with_full_name(with_aliases(with_context, {"player_code": "code"}))
    full = complete_schema(full, ["web_name"], None)
    return with_aliases(full, {"display_name": "name"}).withColumns(text.image_addresses(F.col("code")))


def resolve_period(calendar: DataFrame, fixtures: DataFrame, ordinal: str = "pos") -> tuple[int, bool]:
    """The period to score and whether it is the fallback; the result of the plan is one row."""
    row = pairings.target_period(calendar, fixtures, ordinal).first()
    if row["gameweek"] is None:
        raise NoRowsError("No upcoming fixtures found.")
    return row["gameweek"], row["is_fallback"]


def context_of_period(
    fixtures: DataFrame, teams: DataFrame, period: int, fallback: bool, ordinal: Sequence[str] = ("pos",)
) -> DataFrame:
    """Fixture info of one period; under the fallback from its unfinished fixtures only."""
    played = in_period(fixtures, period)
    if fallback:
        played = played.where(not_finished(F.col("finished")))
    named = pairings.with_team_names(played, teams)
    return pairings.fixture_info(named, stage(pairings.difficulty_table(teams), "difficulty"), ordinal)


def score_entities(
    prepared: DataFrame,
    trees: int = 200,
    depth: int = 15,
    seed: int = 42,
    key: str = "id",
    exclude_features: Sequence[str] = (),
    in_tasks: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train on the active share and score every row. Returns scored rows, quality and feature importance.

    ``points_per_game`` is target and feature alike; name it in ``exclude_features``, with those derived from it, for
    a model without that leak. Such a forest has many times the nodes, so grow it ``in_tasks``.
    """
    features = [name for name in FEATURES if name not in set(exclude_features)]
    vectors = stage(model.with_label(model.assembled(prepared, features)), "vectors")
    training, testing = model.split_rows(active_rows(vectors), key, seed=seed)
    forest = model.train(training, trees, depth, seed=seed, in_tasks=in_tasks)
    scored = model.finish_scores(model.score(forest, vectors).drop(model.LABEL))
    return scored, model.fit_quality(forest, training, testing), model.importance(forest, features)


def run(
    entities: DataFrame,
    teams: DataFrame,
    calendar: DataFrame,
    fixtures: DataFrame,
    folder: str | None = None,
    trees: int = 200,
    depth: int = 15,
    seed: int = 42,
    key: str = "id",
    exclude_features: Sequence[str] = (),
    fixture_ordinal: Sequence[str] = ("pos",),
    calendar_ordinal: str = "pos",
) -> Scored:
    """Score one snapshot and, with a ``folder``, publish it as table partition and CSV export, with the time of refresh.

    Teams that repeat an id count once, the last by ordinal.
    """
    ordinal = ["pos"] if "pos" in teams.columns else [name for name in teams.columns if name != "id"]
    distinct_teams = lookups.lookup_table(teams, ["id"], ordinal)
    period, fallback = resolve_period(calendar, fixtures, calendar_ordinal)
    info = stage(context_of_period(fixtures, distinct_teams, period, fallback, fixture_ordinal), "fixture-info")
    # Training reads the prepared rows once per tree level, and form is read once more for its maximum.
    enriched = stage(enrich(entities, distinct_teams, info), "enriched")
    prepared = prepare_entities(enriched)
    scored, quality, importance = score_entities(prepared, trees, depth, seed, key, exclude_features)
    rows = writers.declared(keep_present(scored, [key, *SNAPSHOT_COLUMNS])).withColumn("gameweek", F.lit(period))
    path = None
    if folder is not None:
        # Scored once, for a sort reads its rows twice; sorted once for two writes.
        rows = writers.in_order(stage(rows, "scored"), best_first(model.PREDICTION, key))
        path = writers.export_csv(rows, folder, period)
        writers.publish_period(rows, f"{folder}/predictions", period)
        writers.stamp(rows.sparkSession, folder)
        rows = in_period(readers.read_published(rows.sparkSession, f"{folder}/predictions"), period, "gameweek")
    return Scored(rows, period, path, quality, importance)


def run_snapshot(spark: SparkSession, envelope_path: str, fixtures_path: str, folder: str | None = None, **settings) -> Scored:
    """The job on landed files: one snapshot document and one fixtures array, of any size; their blocks are read by several tasks."""
    items = documents.split_documents(spark, envelope_path, ["elements", "teams", "events"])
    return run(
        stage(documents.document_rows(items, ENTITY, "elements"), "entities"),
        documents.document_rows(items, TEAM, "teams"),
        documents.document_rows(items, PERIOD, "events"),
        documents.document_rows(documents.split_documents(spark, fixtures_path), FIXTURE),
        folder,
        **settings,
    )
