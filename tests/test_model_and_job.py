import json
import random

import pytest
from pyspark.sql import functions as F

from touchline.constants import FEATURES, SNAPSHOT_COLUMNS
from touchline.operators import model
from touchline.operators.features import feature_matrix, prepare_entities
from touchline.plans import read_query, score_job
from touchline.schemas import PREDICTIONS
from touchline.sources import readers
from touchline.streaming import refresh


def _element(i, generator):
    minutes = generator.randint(45, 900)
    return {
        "id": i, "code": 100 + i, "first_name": f"F{i}", "second_name": f"L{i % 9}", "web_name": f"w{i}",
        "team": i % 4 + 1, "element_type": i % 4 + 1, "minutes": minutes, "starts": minutes // 90, "goals_scored": i % 5,
        "assists": i % 3, "bonus": i % 2, "now_cost": 40 + i % 60, "form": str(i % 7), "points_per_game": str(i % 10 / 2),
        "selected_by_percent": "x" if i % 11 == 0 else "3.5", "transfers_in_event": i, "transfers_out_event": 3,
        "expected_goals": "0.5", "total_points": i, "saves_per_90": 0.0,
        "chance_of_playing_this_round": [0, 100, None][i % 3],
    }


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landed")
    generator = random.Random(5)
    envelope = {
        "elements": [_element(i, generator) for i in range(240)],
        "teams": [{"id": n, "name": f"Team {n}", "strength": n} for n in range(1, 5)],
        "events": [
            {"id": 3, "name": "Gameweek 3", "is_current": True, "is_next": False, "finished": True},
            {"id": 4, "name": "Gameweek 4", "is_current": False, "is_next": True, "finished": False},
        ],
    }
    fixtures = [
        {"id": 1, "event": 3, "team_h": 3, "team_a": 4, "finished": True},
        {"id": 2, "event": 4, "team_h": 1, "team_a": 2, "finished": False},
        {"id": 3, "event": 4, "team_h": 3, "team_a": 1, "finished": None},
        {"id": 4, "event": None, "team_h": 4, "team_a": 2, "finished": None},
    ]
    (folder / "snapshot.json").write_text(json.dumps(envelope, indent=1))
    (folder / "fixtures.json").write_text(json.dumps(fixtures, indent=1))
    return folder


def test_job(spark, landed, tmp_path):
    done = score_job.run_snapshot(
        spark, str(landed / "snapshot.json"), str(landed / "fixtures.json"), str(tmp_path), trees=10, depth=6
    )
    assert done.period == 4
    rows = {r["name"]: r for r in done.rows.collect()}
    assert len(rows) == 240
    assert done.rows.columns == ["id", *SNAPSHOT_COLUMNS, "gameweek"] or set(SNAPSHOT_COLUMNS) - set(done.rows.columns) <= {
        "yellow_cards", "red_cards", "clean_sheets",
    }
    first = rows["F0 L0"]  # team 1 plays twice; its last fixture is away
    assert first["fixture"] == "Team 1 (A) vs Team 3" and first["is_home"] is False
    assert first["opponent_difficulty"] == 3 and first["next_opponent"] == "Team 3"
    assert first["predicted_points"] == 0 and rows["F1 L1"]["predicted_points"] > 0
    assert rows["F3 L3"]["fixture"] == "" and rows["F3 L3"]["next_opponent"] == "No fixture"
    assert first["now_cost"] == 4.0 and first["expected_goals"] == pytest.approx(0.03)
    assert first["image_url_secondary"].endswith("/p100.png")
    assert rows["F2 L2"]["chance_of_playing_this_round"] is None
    quality = {r["share"]: r["r2"] for r in done.quality.collect()}
    assert quality["train"] > 0.9 and quality["test"] > 0.7
    assert done.importance.count() == 5
    assert done.path.endswith("gameweek_4_predictions.csv")
    written = [r["predicted_points"] for r in spark.read.option("header", True).csv(done.path).select(F.col("predicted_points").cast("double")).collect()]
    assert written == sorted(written, reverse=True)
    assert readers.read_newest(spark, str(tmp_path)).count() == 240
    kinds = {f.name: f.dataType for f in done.rows.schema.fields}
    assert all(kinds[f.name] == f.dataType for f in PREDICTIONS.fields if f.name in kinds)
    read = {r["id"]: r for r in readers.read_latest(spark, str(tmp_path)).collect()}
    for row in done.rows.collect():
        for name in set(SNAPSHOT_COLUMNS) & set(done.rows.columns):
            assert read[row["id"]][name] == (row[name] if row[name] != "" else None), name
    shown, metadata = read_query.serve_predictions(spark, str(tmp_path), sort_by="minutes", limit=10)
    assert min(r["minutes"] for r in shown.collect()) > 45 and metadata.first()["filtered_players"] == 10


def test_repeated_teams_count_once(spark):
    teams = spark.createDataFrame([(1, "Old", 2), (1, "New", 5), (2, "B", 3)], "id long, name string, strength long")
    entities = spark.createDataFrame([_element(i, random.Random(i)) | {"team": i % 2 + 1} for i in range(120)])
    calendar = spark.createDataFrame([(0, 4, "n", False, True, False)], "pos long, id long, name string, is_current boolean, is_next boolean, finished boolean")
    fixtures = spark.createDataFrame([(0, 4, 1, 2, False)], "pos long, event long, team_h long, team_a long, finished boolean")
    assert score_job.run(entities, teams, calendar, fixtures, trees=3, depth=3).rows.count() == 120


def test_strata_give_their_share(spark):
    rows = spark.range(1000).withColumn("s", F.when(F.col("id") < 900, "hot").when(F.col("id") < 905, "few"))
    training, testing = model.split_rows(rows, strata=["s"])
    count = lambda df: {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}
    assert count(training) == {"hot": 720, "few": 4, None: 76} and count(testing) == {"hot": 180, "few": 1, None: 19}
    assert training.columns == ["id", "s"]


def test_defaults_are_the_preset():
    import inspect

    from touchline.plans.score_job import run, score_entities

    for function in (model.train, run, score_entities):
        defaults = {n: p.default for n, p in inspect.signature(function).parameters.items()}
        assert (defaults["trees"], defaults["depth"]) == (200, 15)


def test_refresh_scores(spark, landed, tmp_path):
    """A second landed snapshot moves the calendar on; the first period stays published."""
    envelope = json.loads((landed / "snapshot.json").read_text())
    fixtures = readers.read_fixtures(spark, str(landed / "fixtures.json"))
    run = lambda: refresh.refresh_scores(
        spark, str(tmp_path / "landing"), fixtures, str(tmp_path / "out"), str(tmp_path / "state"),
        one_per_line=False, trees=3, depth=3,
    )
    for day, upcoming in ((1, 4), (2, 3)):
        envelope["events"] = [{"id": upcoming, "name": "n", "is_current": False, "is_next": True, "finished": False}]
        (tmp_path / f"landing/gameweek={day}").mkdir(parents=True)
        (tmp_path / f"landing/gameweek={day}/s.json").write_text(json.dumps(envelope, indent=1))
        run()
    table = readers.read_published(spark, str(tmp_path / "out/predictions"))
    assert {r["gameweek"]: r["count"] for r in table.groupBy("gameweek").count().collect()} == {3: 240, 4: 240}
    assert {r["gameweek"] for r in readers.read_newest(spark, str(tmp_path / "out")).collect()} == {4}


def test_published_partition_is_ordered(spark, tmp_path):
    from touchline.operators.ranking import best_first
    from touchline.sources.writers import publish

    rows = spark.range(500).select("id", (F.col("id") * 7 % 83).cast("double").alias("predicted_points"), F.lit(3).alias("gameweek"))
    publish(rows.repartition(6), str(tmp_path / "t"), best_first("predicted_points"))
    files = spark.read.parquet(str(tmp_path / "t/versions")).select("predicted_points", "id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"))
    per_file = {}
    for r in files.orderBy("n").collect():
        per_file.setdefault(r["f"], []).append((-r["predicted_points"], r["id"]))
    assert all(found == sorted(found) for found in per_file.values())
    ranges = sorted((found[0], found[-1]) for found in per_file.values())
    assert all(earlier[1] < later[0] for earlier, later in zip(ranges, ranges[1:]))


def _prepared(spark, rows):
    return prepare_entities(spark.createDataFrame(rows, "id long, minutes long, starts long, form string, points_per_game string"))


def test_feature_matrix_of_sparse_input(spark):
    rows = feature_matrix(_prepared(spark, [(1, 90, None, "4", "2"), (2, None, 3, "x", ""), (3, 450, 5, "8", "0")])).orderBy("id").collect()
    assert list(rows[0].asDict()) == ["id", *FEATURES]
    assert all(v is not None for r in rows for v in r)
    assert rows[0]["minutes_per_game"] == 0 and rows[2]["minutes_per_game"] == 90
    assert rows[0]["form_normalized"] == 0.5
    assert rows[0]["recent_form_trend"] == 1 and rows[2]["recent_form_trend"] == 0
    assert rows[2]["minutes_reliability"] == 1
    assert rows[0]["transfer_momentum"] == 0 and rows[0]["influence"] == 0


def test_split_is_stable_under_repartition(spark):
    df = spark.range(5000)
    one = {r["id"] for r in model.split_rows(df)[0].collect()}
    two = {r["id"] for r in model.split_rows(df.repartition(13))[0].collect()}
    assert one == two
    assert 3800 < len(one) < 4200
    other = {r["id"] for r in model.split_rows(df, seed=7)[0].collect()}
    assert other != one


def test_forest_agrees_across_seeds_and_without_leak(spark):
    generator = random.Random(1)
    rows = [(i, generator.randint(45, 900), 1 + i % 9, str(generator.randint(0, 9)), str(generator.randint(0, 20) / 2)) for i in range(400)]
    prepared = _prepared(spark, rows)
    scores = {}
    for seed in (1, 2):
        scored, quality, _ = score_job.score_entities(
            prepared.withColumn("now_cost", F.lit(50.0)), trees=10, depth=6, seed=seed
        )
        scores[seed] = {r["id"]: r["predicted_points"] for r in scored.collect()}
        assert min(r["r2"] for r in quality.collect()) > 0.85
    rank = lambda found: {i: n for n, i in enumerate(sorted(found, key=lambda i: (found[i], i)))}
    one, two, n = rank(scores[1]), rank(scores[2]), len(rows)
    spearman = 1 - 6 * sum((one[i] - two[i]) ** 2 for i in one) / (n * (n * n - 1))
    assert spearman > 0.95
    leaking = ["points_per_game", "value_indicator", "consistency_score", "recent_form_trend"]
    _, honest, top = score_job.score_entities(
        prepared.withColumn("now_cost", F.lit(50.0)), trees=5, depth=4, exclude_features=leaking
    )
    assert {r["r2"] for r in honest.collect() if r["share"] == "test"}.pop() < 0.5
    assert not set(leaking) & {r["feature"] for r in top.collect()}


def test_unavailable_column_is_optional(spark):
    df = spark.createDataFrame([(10.0, 95.0)], "predicted_points double, now_cost double")
    row = model.finish_scores(df).first()
    assert row["predicted_points"] == pytest.approx(6) and row["now_cost"] == 9.5 and row["expected_goals"] == 0


@pytest.mark.parametrize("upto", ["10m", "-1"])
def test_forest_is_the_mean_of_its_trees(spark, upto):
    """The saved nodes, walked level by level as joins, give the model's own predictions by value."""
    generator = random.Random(3)
    rows = [(i, generator.randint(45, 900), 1 + i % 9, str(generator.randint(0, 9)), str(generator.randint(0, 20) / 2)) for i in range(300)]
    vectors = model.with_label(model.assembled(_prepared(spark, rows)))
    forest = model.train(vectors, trees=12, depth=7)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", upto)
    try:
        nodes = model.node_table(forest)
        assert nodes.select("tree").distinct().count() == 12 and nodes.where("left < 0").count() > 12
        walked = {r["id"]: r["walked"] for r in model.walked_predictions(nodes, vectors.select("id", model.VECTOR), "id", 7).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    own = {r["id"]: r[model.PREDICTION] for r in forest.transform(vectors).collect()}
    assert walked.keys() == own.keys() and all(abs(walked[i] - own[i]) < 1e-9 for i in own) and len(set(own.values())) > 20


def test_statistics_of_a_pass_are_bounded(spark, monkeypatch):
    """One task for each core, whatever the files; how many passes there are changes no tree."""
    generator = random.Random(3)
    rows = [(i, generator.randint(45, 900), 1 + i % 9, str(generator.randint(0, 9)), str(generator.randint(0, 20) / 2)) for i in range(300)]
    vectors = model.with_label(model.assembled(_prepared(spark, rows)))
    seen, fit = [], model.RandomForestRegressor.fit

    def fitted(forest, given):
        seen.append((given.rdd.getNumPartitions(), forest.getMaxMemoryInMB()))
        return fit(forest, given)

    monkeypatch.setattr(model.RandomForestRegressor, "fit", fitted)
    many = vectors.repartition(40, "id")
    forests = [model.train(many, trees=6, depth=6, **settings) for settings in ({}, {"memory_mb": 1}, {"memory_mb": 1024})]
    assert all(parts <= spark.sparkContext.defaultParallelism for parts, _ in seen) and seen[0][1] <= 256
    one, two, three = ([tree.toDebugString for tree in forest.trees] for forest in forests)
    strip = lambda texts: [text.split("\n", 1)[1] for text in texts]
    assert strip(one) == strip(two) == strip(three)
