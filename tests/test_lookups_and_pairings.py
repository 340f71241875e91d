import pytest
from pyspark.sql import functions as F

from touchline.functions import text
from touchline.operators import lookups, pairings
from touchline.operators.filters import NoRowsError
from touchline.plans.score_job import resolve_period

TEAMS = [(0, 1, "A", 1), (1, 2, "B", 2), (2, 3, "C", None), (3, 4, "D", 5)]
CALENDAR = "pos int, id int, name string, is_current boolean, is_next boolean, finished boolean"
FIXTURE = "pos int, event int, team_h int, team_a int, finished boolean"


def _rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, None), ("j", 5, "c"), (None, 1, "d")], "k string, pos int, v string")
    last = {(r["k"], r["v"]) for r in lookups.keep_last(df, ["k"], ["pos"]).collect()}
    assert last == {("k", None), ("j", "c"), (None, "d")}
    assert ("k", "a") in {(r["k"], r["v"]) for r in lookups.keep_first(df, ["k"], ["pos"]).collect()}


def test_lookup_defaults(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "n")], "id int, team string")
    dim = spark.createDataFrame([(1, "one"), (2, None)], "key int, name string")
    got = _rows(lookups.look_up(df, dim, {"id": "key"}, {"team": "name", "d": "name"}, {"d": "none"}), "id")
    assert got[1] == {"id": 1, "team": "one", "d": "one"}
    assert got[2] == {"id": 2, "team": None, "d": None}
    assert got[3] == {"id": 3, "team": None, "d": "none"}
    assert got[None] == {"id": None, "team": None, "d": "none"}


def test_code_label(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "c int")
    assert [r[0] for r in df.select(lookups.code_label(F.col("c"), {1: "GKP"})).collect()] == ["GKP", None, None]


def test_enrich_by_name(spark):
    source = spark.createDataFrame([("N", 1, 0), ("N", 2, 1)], "full_name string, code long, pos int")
    df = spark.createDataFrame([("N", 9), ("M", 9)], "name string, player_code long")
    got = _rows(lookups.enrich_by_name(df, source), "name")
    assert got["N"]["player_code"] == 2 and got["M"]["player_code"] is None
    missing = lookups.enrich_by_name(df, None).withColumn("u", text.image_address(F.col("player_code")))
    assert all(r["player_code"] is None and r["u"] is None for r in missing.collect())


def _teams(spark):
    return spark.createDataFrame(TEAMS, "pos int, id int, name string, strength int")


def test_double_lookup(spark):
    fixtures = spark.createDataFrame([(0, 1, 1, 2, None), (1, 1, 9, 3, None)], FIXTURE)
    got = _rows(pairings.with_team_names(fixtures, _teams(spark)), "pos")
    assert (got[0]["home_team"], got[0]["away_team"]) == ("A", "B")
    assert (got[1]["home_team"], got[1]["away_team"]) == (None, "C")


def _info(spark, pairs, every=False):
    fixtures = spark.createDataFrame(pairs, "pos int, home_team string, away_team string")
    rated = _teams(spark).where("name != 'D'")
    return pairings.fixture_info(fixtures, pairings.difficulty_table(rated), every=every)


def test_last_fixture_wins(spark):
    got = _rows(_info(spark, [(0, "A", "B"), (1, "C", "A")]), "team")
    assert (got["A"]["opponent"], got["A"]["is_home"]) == ("C", False)
    assert got["A"]["difficulty"] is None  # C has a rating row without a strength
    assert got["A"]["fixture"] == "A (A) vs C"
    assert got["B"]["difficulty"] == 5
    assert _info(spark, [(0, "A", "B"), (1, "C", "A")], every=True).count() == 4


def test_same_team_on_both_sides_keeps_away(spark):
    assert _rows(_info(spark, [(0, "A", "A")]), "team")["A"]["is_home"] is False


def test_unrated_opponent_gets_default(spark):
    assert _rows(_info(spark, [(0, "A", "D")]), "team")["A"]["difficulty"] == 3


def test_attach_fixture(spark):
    entities = spark.createDataFrame([(1, "A"), (2, "D"), (3, None), (4, "B")], "id int, team string")
    got = _rows(pairings.attach_fixture(entities, _info(spark, [(0, "A", "B")])), "id")
    assert got[1]["difficulty_adjustment"] == pytest.approx((6 - 4) / 10 * 1.1)
    for lost in (got[2], got[3]):
        assert lost["is_home"] is False and lost["opponent"] == "" and lost["fixture"] == ""
        assert lost["opponent_difficulty"] == 0 and lost["next_opponent"] == "No fixture"
        assert lost["difficulty_adjustment"] == pytest.approx(0.6)
    assert got[4]["next_opponent"] == "A"


def test_first_rating_of_a_repeated_name_wins(spark):
    teams = spark.createDataFrame([(1, "A", None), (2, "A", 4)], "id int, name string, strength int")
    assert pairings.difficulty_table(teams).first()["difficulty"] is None


@pytest.mark.parametrize(
    ("periods", "expected"),
    [
        ([(0, 3, "Gameweek 3", True, False, True), (1, 4, "Gameweek 4", False, True, False)], (3, 4, "Gameweek 4", True)),
        ([(0, 3, "Gameweek 3", True, False, False)], (3, 4, "Gameweek 4", False)),
        ([(0, 7, "x", False, False, None)], (1, 2, "Gameweek 2", False)),
        ([(0, 5, "five", True, True, None), (1, 6, "six", True, True, True)], (5, 5, "five", False)),
    ],
)
def test_period_status(spark, periods, expected):
    row = pairings.period_status(spark.createDataFrame(periods, CALENDAR)).first()
    assert (row["current_id"], row["next_id"], row["next_name"], row["current_finished"]) == expected


def _calendar(spark, upcoming):
    return spark.createDataFrame([(0, upcoming, "n", False, True, False)], CALENDAR)


def test_target_period(spark):
    fixtures = spark.createDataFrame([(0, 2, 1, 2, True), (1, 4, 1, 2, None), (2, 4, 1, 2, True), (3, 5, 1, 2, False), (4, None, 1, 2, False)], FIXTURE)
    assert tuple(pairings.target_period(_calendar(spark, 5), fixtures).first()) == (5, False)
    assert tuple(pairings.target_period(_calendar(spark, 99), fixtures).first()) == (4, True)
    chosen = pairings.fixtures_of_target(_calendar(spark, 99), fixtures)
    assert [r["pos"] for r in chosen.collect()] == [1]
    assert [r["pos"] for r in pairings.fixtures_of_target(_calendar(spark, 2), fixtures).collect()] == [0]


@pytest.mark.parametrize("rows", [[], [(0, 2, 1, 2, True)], [(0, None, 1, 2, False)]])
def test_no_period_is_an_error(spark, rows):
    fixtures = spark.createDataFrame(rows, FIXTURE)
    with pytest.raises(NoRowsError):
        resolve_period(_calendar(spark, 99), fixtures)
    if rows:
        with pytest.raises(Exception, match="No upcoming fixtures"):
            pairings.fixtures_of_target(_calendar(spark, 99), fixtures).collect()


def test_sides_double_the_rows(spark):
    pairs = spark.createDataFrame([(i, f"h{i}", f"a{i % 3}") for i in range(50)], "pos int, home_team string, away_team string")
    rows = pairings.sides(pairs)
    assert rows.count() == 100
    assert rows.where("is_home").count() == 50
