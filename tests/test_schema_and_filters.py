import pytest
from pyspark.sql import functions as F

from touchline.constants import COLUMN_CATALOGUE, DEFAULT_VISIBLE, FEATURES, SNAPSHOT_COLUMNS
from touchline.operators import filters, schema


def test_fixed_tables_have_the_expected_size():
    assert len(FEATURES) == 27
    assert len(SNAPSHOT_COLUMNS) == 27
    assert len(COLUMN_CATALOGUE) == 20
    assert len(DEFAULT_VISIBLE) == 10


def test_projections(spark):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    assert schema.select_renamed(df, {"name": "team", "id": "key"}).columns == ["team", "key"]
    assert schema.keep_present(df, ["name", "nothing", "id"]).columns == ["name", "id"]
    assert schema.complete_schema(df, ["id", "extra"]).first()["extra"] == 0.0
    assert schema.with_aliases(df, {"code": "id"}).first()["code"] == 1
    assert schema.column_list(df) == ["id", "name"]


def test_visible_columns(spark):
    assert schema.toggle(["name", "team"], "name") == ["name", "team"]
    assert schema.toggle(["name", "team"], "team") == ["name"]
    assert schema.toggle(["name"], "form") == ["name", "form"]
    df = spark.createDataFrame([("x", 1.0, "t")], "name string, form double, team string")
    assert schema.visible_columns(df, ["form", "team"]).columns == ["name", "team", "form"]
    assert schema.display_table(df).columns == ["Player", "Team", "Form"]


def test_fill_missing(spark):
    df = spark.createDataFrame(
        [(None, float("nan"), None, None)], "i long, d double, b boolean, s string"
    )
    assert tuple(schema.fill_missing(df).first()) == (0, 0.0, False, None)
    assert schema.fill_missing(df, "0").first()["s"] == "0"


def test_coerce_numbers(spark):
    df = spark.createDataFrame([("1.5", 2, float("nan")), ("x", None, 1.0)], "a string, b long, c double")
    assert [tuple(r) for r in schema.coerce_numbers(df, ["a", "b", "c", "absent"]).collect()] == [(1.5, 2.0, 0.0), (0.0, 0.0, 1.0)]


def test_entity_detail(spark):
    df = spark.createDataFrame(
        [(1, 7.25, 2, True, 9.5, 4.0, 55, 3.2, 90, 0.123, 1, 2, 3, 4, 0, 0.5, 0.0)],
        """id int, predicted_points double, opponent_difficulty int, is_home boolean, now_cost double,
           points_per_game double, total_points int, form double, minutes int, expected_goals double, goals_scored int,
           assists int, clean_sheets int, yellow_cards int, red_cards int, saves_per_90 double,
           chance_of_playing_this_round double""",
    )
    card = schema.entity_detail(df).first()
    assert len(card) == 6
    assert card["predictions"]["opponent_difficulty"] == "2/5"
    assert card["predictions"]["venue"] == "Home"
    assert card["value"]["price"] == "£9.5m"
    assert card["performance"]["expected_goals"] == "0.12"
    assert card["availability"]["chance_of_playing"] == "Unknown%"


TEAMS = [(1, "A.B", "GKP", "Ann"), (2, "AXB", "DEF", "Bob"), (3, None, "DEF", None), (4, "a.b", None, "ANNA")]


def _ids(df):
    return sorted(r["id"] for r in df.collect())


def test_text_filters(spark):
    df = spark.createDataFrame(TEAMS, "id int, team string, position string, name string")
    assert _ids(filters.matching_rows(df, team=".", literal=True)) == [1, 4]
    assert _ids(filters.matching_rows(df, team="A.B")) == [1, 2, 4]
    assert _ids(filters.matching_rows(df, search="ann")) == [1, 4]
    assert _ids(filters.matching_rows(df, position="DEF", team="x")) == [2]
    assert _ids(filters.matching_rows(df, position="def")) == []
    assert _ids(filters.matching_rows(df)) == [1, 2, 3, 4]


def test_truthy_rows(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "s string")
    assert filters.truthy_rows(df, "s").count() == 1


def test_not_finished(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, finished boolean")
    assert _ids(df.where(filters.not_finished(F.col("finished")))) == [2, 3]


@pytest.mark.parametrize(("busy", "kept"), [(99, 109), (100, 100), (0, 10)])
def test_active_rows(spark, busy, kept):
    rows = [(i, 45) for i in range(busy)] + [(1000 + i, 1) for i in range(10)] + [(2000, 0), (2001, None)]
    df = spark.createDataFrame(rows, "id int, minutes int")
    assert filters.active_rows(df).count() == kept


def test_required_rows(spark):
    with pytest.raises(filters.NoRowsError):
        filters.require_rows(spark.range(0), "nothing")
    assert filters.require_rows(spark.range(1), "nothing").count() == 1
