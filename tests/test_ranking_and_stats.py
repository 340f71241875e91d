import math
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import ranking, stats
from touchline.plans.read_query import predictions_query


def _values(df, column):
    return [r[column] for r in df.collect()]


def test_requested_order_puts_missing_last(spark):
    df = spark.createDataFrame([(1, "1"), (2, None), (3, "2"), (4, "x")], "id int, form string")
    for direction, wanted in (("asc", [1, 3, 2, 4]), ("desc", [3, 1, 2, 4]), ("other", [3, 1, 2, 4])):
        rows, order = ranking.requested_order(df, "form", direction)
        assert _values(ranking.take_sorted(rows, order), "id") == wanted
    rows, order = ranking.requested_order(df, "unknown")
    assert _values(ranking.take_sorted(rows, order, 2), "id") == [1, 2]


def test_client_order(spark):
    df = spark.createDataFrame([(1, -1.0, "b", True), (2, None, None, None), (3, 1.0, "a", False)], "id int, v double, s string, f boolean")
    assert _values(df.orderBy(*ranking.client_order(df, "f", "asc")), "id") == [2, 3, 1]
    assert _values(df.orderBy(*ranking.client_order(df, "v", "asc")), "v") == [-1.0, None, 1.0]
    assert _values(df.orderBy(*ranking.client_order(df, "v", "desc")), "v") == [1.0, None, -1.0]
    assert _values(df.orderBy(*ranking.client_order(df, "s", "asc")), "s") == ["a", "b", None]
    assert _values(df.orderBy(*ranking.client_order(df, "s", "desc")), "s") == ["b", "a", None]


def test_limit_and_numbers(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7).repartition(8)
    top = ranking.numbered(ranking.take_sorted(df, ranking.best_first("v"), 20))
    wanted = sorted(((i % 7, i) for i in range(1000)), key=lambda p: (-p[0], p[1]))[:20]
    assert [(r["v"], r["id"], r["rank"]) for r in top.collect()] == [(v, i, n) for n, (v, i) in enumerate(wanted, 1)]
    assert ranking.take_sorted(df, ranking.best_first("v"), 0).count() == 1000


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_ranks_of_a_hot_group(spark, partitions):
    """One group holds most rows, most of them tied; the ranks must still be those of a plain sort."""
    generator = random.Random(partitions)
    rows = [(i, "hot" if i % 10 else generator.choice(["x", "y", None]), generator.choice([1.0, 1.0, 2.0, None])) for i in range(3000)]
    generator.shuffle(rows)
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(partitions)
    got = {r["id"]: r["rank"] for r in ranking.rank_rows(df, ranking.best_first("v"), ["g"]).collect()}
    wanted = {}
    for group in {g for _, g, _ in rows}:
        ordered = sorted((r for r in rows if r[1] == group), key=lambda r: (math.inf if r[2] is None else -r[2], r[0]))
        wanted |= {r[0]: n for n, r in enumerate(ordered, 1)}
    assert got == wanted


def test_overall_ranks_and_empty_input(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 37 % 101)
    got = {r["id"]: r["rank"] for r in ranking.rank_rows(df, ranking.best_first("v")).collect()}
    wanted = sorted(range(500), key=lambda i: (-(i * 37 % 101), i))
    assert got == {i: n for n, i in enumerate(wanted, 1)}
    assert ranking.rank_rows(spark.range(0).withColumn("v", F.col("id")), ranking.best_first("v")).count() == 0


def test_rank_does_not_window_over_rows(spark):
    df = spark.range(100).withColumn("v", F.col("id"))
    plan = ranking.rank_rows(df, ranking.best_first("v"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumns({"g": F.col("id") % 3, "v": F.col("id") % 50})
    top = ranking.top_per_group(df, ["g"], ranking.best_first("v"), 4)
    assert top.count() == 12
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_counts_with_missing(spark):
    df = spark.createDataFrame([("A",), ("A",), (None,)], "team string")
    assert df.agg(stats.distinct_with_missing("team")).first()[0] == 2
    assert [tuple(r) for r in stats.value_counts(df, "team").collect()] == [("A", 2)]
    blank = spark.createDataFrame([("b",), ("",), (None,), ("a",), ("b",)], "team string")
    assert _values(stats.sorted_distinct(blank), "team") == ["a", "b"]


def test_value_counts_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "position string")
    assert _values(stats.value_counts(df), "position") == ["c", "a", "b"]


def test_statistics(spark):
    df = spark.createDataFrame([("A", 1.0), (None, None), ("A", 4.0)], "team string, predicted_points double")
    shown = ["total_players", "avg_predicted_points", "max_predicted_points", "teams", "columns"]
    assert tuple(stats.prediction_statistics(df).select(*shown).first()) == (3, 2.5, 4.0, 2, "team,predicted_points")
    assert tuple(stats.prediction_statistics(df.select(F.lit(1).alias("x"))).select(*shown).first()) == (3, 0.0, 0.0, 0, "x")
    placed = spark.createDataFrame([("MID",), ("DEF",), (None,), ("MID",)], "position string")
    assert stats.prediction_statistics(placed).first()["positions"] == {"DEF": 1, "MID": 2}


def test_statistics_of_no_rows(spark):
    empty = spark.createDataFrame([], "team string, position string, predicted_points double")
    row = stats.prediction_statistics(empty).first().asDict()
    assert row == {
        "total_players": 0, "avg_predicted_points": None, "max_predicted_points": None, "positions": {}, "teams": 0,
        "columns": "team,position,predicted_points",
    }
    assert empty.agg(stats.distinct_with_missing("team")).first()[0] == 0


def test_no_number_comes_last(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 5.0), (3, None), (4, -1.0)], "id long, v double")
    assert [r["id"] for r in df.orderBy(*ranking.best_first("v")).collect()][:2] == [2, 4]
    assert [r["id"] for r in df.orderBy(*ranking.client_order(df, "v")).collect()] == [2, 1, 3, 4]


def test_unknown_sort_column_keeps_the_published_order(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (2, "B", 3.0), (3, "C", 3.0)], "id long, name string, predicted_points double")
    shown = predictions_query(df, sort_by="nothing", limit=2)
    assert [r["id"] for r in shown.collect()] == [2, 3]


@pytest.mark.parametrize(("values", "scaled"), [([2.0, 4.0, None], [0.5, 1.0, None]), ([0.0, 0.0], [0.0, 0.0]), ([None], [0.0])])
def test_scaled_by_maximum(spark, values, scaled):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    assert _values(stats.scaled_by_maximum(df, "v", "s").orderBy("id"), "s") == scaled


def test_r_squared(spark):
    rows = [(1.0, 1.5), (2.0, 1.5), (4.0, 4.0), (7.0, 8.0)]
    mean = sum(y for y, _ in rows) / 4
    wanted = 1 - sum((y - p) ** 2 for y, p in rows) / sum((y - mean) ** 2 for y, _ in rows)
    got = stats.r_squared(spark.createDataFrame(rows, "y double, p double"), "y", "p").first()["r2"]
    assert got == pytest.approx(wanted)


def test_smallest_period(spark):
    df = spark.createDataFrame([(3, True), (5, False), (4, None), (None, False)], "event int, finished boolean")
    assert stats.smallest_period(df, ~F.coalesce("finished", F.lit(False))).first()[0] == 4
