import itertools
import random

import pytest
from pyspark.sql import functions as F

from touchline.constants import FORMATIONS
from touchline.operators import lineup

COLUMNS = "team string, id int, position string, predicted_points double, now_cost double"
FULL = {"GKP": 2, "DEF": 6, "MID": 6, "FWD": 4}


def _squad(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def _rows(counts, points, team="t", start=0):
    ids = itertools.count(start)
    return [(team, next(ids), position, float(points(position, n)), 5.0) for position, count in counts.items() for n in range(count)]


def _brute_force(rows):
    """Formation and ids chosen by trying every formation."""
    ranked = {
        position: sorted((r for r in rows if r[2] == position), key=lambda r: (-(r[3] or 0), r[1]))
        for position in ("GKP", "DEF", "MID", "FWD")
    }
    pick = lambda d, m, f: ranked["GKP"][:1] + ranked["DEF"][:d] + ranked["MID"][:m] + ranked["FWD"][:f]
    best, chosen = 0, None
    for name, d, m, f in FORMATIONS:
        team = pick(d, m, f)
        if len(team) == 11:
            total = sum(round((r[3] or 0) * 10**6) for r in team)
            if total > best:
                best, chosen = total, (name, team)
    name, team = chosen or ("4-4-2", pick(4, 4, 2))
    return name, {r[1] for r in team}


def test_earlier_formation_wins_a_tie(spark):
    got = lineup.best_eleven(_squad(spark, _rows(FULL, lambda p, n: 1)), ["team"])
    assert {r["formation"] for r in got.collect()} == {"3-4-3"}
    assert got.count() == 11


def test_no_positive_total_falls_back(spark):
    got = lineup.best_eleven(_squad(spark, _rows(FULL, lambda p, n: -n)), ["team"]).collect()
    assert {r["formation"] for r in got} == {"4-4-2"}
    assert len(got) == 11


def test_too_few_forwards(spark):
    counts = {"GKP": 1, "DEF": 5, "MID": 5, "FWD": 0}
    summary = lineup.best_eleven_summary(_squad(spark, _rows(counts, lambda p, n: 2)), ["team"]).first()
    assert (summary["formation"], summary["players"]) == ("4-4-2", 9)
    assert summary["total_points"] == pytest.approx(18)
    assert summary["average_points"] == pytest.approx(18 / 11)
    assert summary["total_cost"] == pytest.approx(45)


def test_missing_points_and_unknown_positions(spark):
    rows = _rows(FULL, lambda p, n: n) + [("t", 900, "XXX", 99.0, 1.0), ("t", 901, None, 99.0, 1.0), ("t", 902, "FWD", None, 1.0)]
    got = lineup.best_eleven(_squad(spark, rows), ["team"]).collect()
    assert {r["id"] for r in got} == _brute_force([r for r in rows if r[1] < 900 or r[1] == 902])[1]


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    generator = random.Random(seed)
    rows, ids = [], itertools.count()
    for team in range(12):
        for position in ("GKP", "DEF", "MID", "FWD"):
            for _ in range(generator.choice([0, 1, 3, 4, 5, 8])):
                points = generator.choice([None, -1.0, 0.0, 0.1, 0.2, 0.3, generator.random() * 10])
                rows.append((f"t{team}", next(ids), position, points, 1.0))
    by_team = {}
    for r in lineup.best_eleven(_squad(spark, rows).repartition(5), ["team"]).collect():
        by_team.setdefault(r["team"], (r["formation"], set()))[1].add(r["id"])
    teams = {r[0] for r in rows}
    assert by_team == {team: _brute_force([r for r in rows if r[0] == team]) for team in teams}
    overall = lineup.best_eleven(_squad(spark, rows)).collect()
    assert (overall[0]["formation"], {r["id"] for r in overall}) == _brute_force(rows)


def test_hot_team_and_kept_columns(spark):
    """One team holds nearly all rows; each task sends at most five of its rows per position."""
    df = spark.range(20000).select(
        F.when(F.col("id") % 20 == 0, "small").otherwise("hot").alias("team"),
        F.col("id").cast("int").alias("id"),
        F.element_at(F.array(*[F.lit(p) for p in FULL]), (F.col("id") % 4 + 1).cast("int")).alias("position"),
        (F.col("id") % 97).cast("double").alias("predicted_points"),
        F.lit(1.0).alias("now_cost"),
        F.concat(F.lit("n"), F.col("id")).alias("name"),
    )
    got = lineup.best_eleven(df, ["team"], keep=["name"])
    assert got.groupBy("team").count().count() == 2
    assert all(r["name"] == f"n{r['id']}" for r in got.collect())
    shape = {r["position"]: r["count"] for r in got.where("team = 'hot'").groupBy("position").count().collect()}
    assert sum(shape.values()) == 11 and shape["GKP"] == 1
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_slots_count_from_one(spark):
    got = lineup.best_eleven(_squad(spark, _rows(FULL, lambda p, n: n)), ["team"])
    slots = {}
    for r in got.collect():
        slots.setdefault(r["position"], set()).add(r["slot"])
    assert all(found == set(range(1, len(found) + 1)) for found in slots.values())


def test_no_number_is_no_points(spark):
    rows = [(i, p, float("nan") if i == 0 else 5.0 - i / 100) for i, p in enumerate(["GKP"] + ["GKP", "DEF", "MID", "FWD"] * 6)]
    df = spark.createDataFrame([(i, p, v, 1.0) for i, p, v in rows], "id long, position string, predicted_points double, now_cost double")
    keeper = lineup.best_eleven(df).where("position = 'GKP'").first()
    assert keeper["id"] == 1 and keeper["predicted_points"] == 4.99


def test_group_without_candidates_has_an_empty_line_up(spark):
    df = spark.createDataFrame([("a", 1, "GKP", 2.0, 4.0), ("b", 2, "COACH", 9.0, 9.0), ("b", 3, None, 9.0, 9.0)], "team string, id long, position string, predicted_points double, now_cost double")
    summary = {r["team"]: r for r in lineup.best_eleven_summary(df, ["team"]).collect()}
    assert tuple(summary["b"])[1:] == ("4-4-2", 0, 0.0, 0.0, 0.0)
    assert (summary["a"]["players"], summary["a"]["total_points"]) == (1, 2.0)
    assert {r["team"] for r in lineup.best_eleven(df, ["team"]).collect()} == {"a"}
    texts = {r["team"]: tuple(r)[1:] for r in lineup.lineup_texts(lineup.best_eleven_summary(df, ["team"]), ["team"]).collect()}
    assert texts == {"a": ("2.0", "£4.0m", "0.2", "4-4-2"), "b": ("0.0", "£0.0m", "0.0", "4-4-2")}
    assert tuple(lineup.best_eleven_summary(df.where("false")).first()) == ("4-4-2", 0, 0.0, 0.0, 0.0)
