"""The forest whose trees are grown whole in tasks, against MLlib's."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressionModel
from pyspark.sql import functions as F

from touchline.constants import FEATURES
from touchline.operators import forest, model
from touchline.operators.features import prepare_entities
from touchline.plans import score_job


def _rows(count, seed=3):
    """Features of many values, of few, of one and of two, and a label that follows some of them."""
    draw = np.random.default_rng(seed)
    x = np.stack([draw.normal(size=count), draw.integers(0, 9, count), np.full(count, 7.0), draw.integers(0, 2, count), np.round(draw.exponential(size=count), 1)], axis=1)
    return x, np.round(2 * x[:, 0] + x[:, 1] * x[:, 3] + draw.normal(size=count), 1)


def _frame(spark, x, y):
    rows = [(i, Vectors.dense(row), float(label)) for i, (row, label) in enumerate(zip(x.tolist(), y))]
    return spark.createDataFrame(rows, ["id", model.VECTOR, model.LABEL])


@pytest.mark.parametrize("depth, leaf", [(4, 2), (9, 1), (15, 2), (6, 40)])
def test_tree_without_draws_is_mllibs(spark, depth, leaf):
    x, y = _rows(3000)
    y += np.random.default_rng(4).normal(size=len(y))  # splits that tie are of the same rows then
    bins = [forest.cuts_of(column) for column in x.T]
    assert [len(cuts) for cuts in bins][1:4] == [8, 0, 1] and len(bins[0]) == 31
    *tree, gains = forest.grown_tree(forest.coded(x, bins), y, np.ones(len(y), np.int64), bins, depth, leaf)
    df = _frame(spark, x, y)
    theirs = DecisionTreeRegressor(featuresCol=model.VECTOR, labelCol=model.LABEL, maxDepth=depth, minInstancesPerNode=leaf, seed=1).fit(df)
    found = np.array([r["prediction"] for r in theirs.transform(df).orderBy("id").select("prediction").collect()])
    assert np.abs(forest.walk(tree, x) - found).max() < 1e-9
    assert np.abs(gains / gains.sum() - theirs.featureImportances.toArray()).max() < 0.01


def test_tree_by_hand():
    """The largest fall in variance over both features; draws count as rows, and a row without a draw counts nothing."""
    x, y = np.array([[0.0, 5], [1, 5], [2, 6], [3, 6], [9, 9]]), np.array([1.0, 1, 4, 8, 100])
    bins = [forest.cuts_of(column) for column in x[:4].T]
    assert bins == [[0.5, 1.5, 2.5], [5.5]]
    feature, threshold, left, value, gains = forest.grown_tree(forest.coded(x, bins), y, np.array([1, 1, 1, 2, 0]), bins, 2, 1)
    assert feature.tolist() == [0, 0, 0, 0, 0] and left.tolist() == [1, 3, 2, 3, 4]
    assert threshold.tolist() == [2.5, 1.5, np.inf, np.inf, np.inf]
    assert value == pytest.approx([22 / 5, 2, 8, 1, 4])
    assert gains == pytest.approx([(6**2 / 3 + 16**2 / 2 - 22**2 / 5) + (2**2 / 2 + 4**2 - 6**2 / 3), 0])
    # With two rows on each side at least, the second level has no split.
    assert forest.grown_tree(forest.coded(x, bins), y, np.array([1, 1, 1, 2, 0]), bins, 2, 2)[2].tolist() == [1, 1, 2]


@pytest.mark.parametrize("x, y", [([[1.0, 2]], [3.0]), ([[1.0, 2], [1, 2]], [3.0, 5]), ([[1.0, 2], [4, 2], [5, 2]], [3.1, 3.1, 3.1])])
def test_rows_without_a_split_have_the_mean(spark, x, y):
    made = model.train(_frame(spark, np.array(x), np.array(y)), trees=4, depth=3, leaf=1, in_tasks=True)
    assert all(len(tree[3]) == 1 and (tree[3][0] == 0 or min(y) - 1e-9 <= tree[3][0] <= max(y) + 1e-9) for tree in made.trees)
    assert made.featureImportances.toArray().tolist() == [0, 0] and made.totalNumNodes == 4


def test_tasks_change_no_tree():
    x, y = _rows(500)
    bins = [forest.cuts_of(column) for column in x.T]
    pack = list(forest._packing(bins)([pa.record_batch({"x": pa.array(part.tolist(), pa.list_(pa.float64())), "y": pa.array(labels)}) for part, labels in ((x[:200], y[:200]), (x[200:], y[200:]))]))
    read = lambda task, order: [pa.record_batch({"codes": pack[n].column(0), "labels": pack[n].column(1), "block": pa.array([n]), "task": pa.array([task])}) for n in order]
    grown = lambda tasks, order: {b.column("tree")[0].as_py(): b.to_pylist() for task in range(tasks) for b in forest._growing(bins, 7, tasks, 6, 2, 42)(iter(read(task, order)))}
    one = grown(1, [0, 1])
    assert sorted(one) == list(range(7)) and len({row[0]["left"] for row in one.values()}) == 7
    assert grown(3, [1, 0]) == one


def test_forest_is_as_good_as_mllibs(spark, tmp_path):
    x, y = _rows(2500)
    df = _frame(spark, x, y)
    df.repartition(5, "id").write.parquet(str(tmp_path / "rows"))
    training, testing = model.split_rows(spark.read.parquet(str(tmp_path / "rows")))
    made = [model.train(training, trees=30, depth=10, in_tasks=in_tasks) for in_tasks in (False, True)]
    assert isinstance(made[0], RandomForestRegressionModel) and isinstance(made[1], forest.Forest) and len(made[1].trees) == 30
    theirs, ours = ({r["share"]: r["r2"] for r in model.fit_quality(one, training, testing).collect()} for one in made)
    assert all(abs(theirs[share] - ours[share]) < 0.02 for share in ("train", "test")) and ours["train"] > ours["test"] > 0.7
    assert abs(made[0].totalNumNodes - made[1].totalNumNodes) < 0.05 * made[0].totalNumNodes
    assert np.abs(made[0].featureImportances.toArray() - made[1].featureImportances.toArray()).max() < 0.02
    assert made[1].featureImportances.toArray().sum() == pytest.approx(1)
    # The mean over the trees, by hand, and the same in a second run.
    mean = sum(forest.walk(tree, x) for tree in made[1].trees) / 30
    scored = {r["id"]: r[model.PREDICTION] for r in model.score(made[1], df).collect()}
    assert scored == pytest.approx(dict(enumerate(mean))) and len(scored) == 2500
    again = model.train(training, trees=30, depth=10, in_tasks=True)
    assert all((a == b).all() for one, two in zip(made[1].trees, again.trees) for a, b in zip(one, two))


def test_too_many_rows_for_a_task_are_left_to_passes(spark, monkeypatch):
    df = _frame(spark, *_rows(60))
    monkeypatch.setattr(forest, "MOST_ROWS", 59)
    assert isinstance(model.train(df, trees=2, depth=2, in_tasks=True), RandomForestRegressionModel)
    monkeypatch.setattr(forest, "MOST_ROWS", 60)
    assert isinstance(model.train(df, trees=2, depth=2, in_tasks=True), forest.Forest)


def test_quality_query_shuffles_no_statistics(spark, monkeypatch):
    """rf_quality grows both forests whole, at the preset of 200 trees of depth 15."""
    from driver_queries import catalogue

    def passes(*_):
        raise AssertionError("a forest was grown by passes")

    sizes, grow = [], forest.grow
    monkeypatch.setattr(model.RandomForestRegressor, "fit", passes)
    monkeypatch.setattr(forest, "grow", lambda *given: sizes.append(given[4:7]) or grow(*given))
    rows = catalogue.QUERIES["rf_quality"](spark, "/root/testdata/sf0.001").collect()
    assert sizes == [(200, 15, 2)] * 2
    assert [(r["features"], r["share"], r["at_most_one"], r["good"]) for r in rows if r["share"] == "train"] == [("all", "train", True, True), ("without target", "train", True, None)]
    assert len(rows) == 4


def test_job_scores_are_left_to_mllib(spark, monkeypatch):
    """Only who asks for it gets other draws."""
    generator = random.Random(1)
    rows = [(i, generator.randint(45, 900), 1 + i % 9, str(generator.randint(0, 9)), str(generator.randint(0, 20) / 2), 50.0) for i in range(200)]
    prepared = prepare_entities(spark.createDataFrame(rows, "id long, minutes long, starts long, form string, points_per_game string, now_cost double"))
    monkeypatch.setattr(forest, "grow", None)
    scored, quality, top = score_job.score_entities(prepared, trees=3, depth=3)
    assert scored.where(F.col(model.PREDICTION).isNotNull()).count() == 200 and quality.count() == 2 and top.first()["feature"] in FEATURES
