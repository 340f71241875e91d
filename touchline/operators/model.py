"""Random-forest regression over the feature matrix, with MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.constants import FEATURES
from touchline.functions import numbers
from touchline.operators import forest
from touchline.operators.features import PREFIX, with_features
from touchline.operators.ranking import rank_rows
from touchline.operators.stats import r_squared
from touchline.session import new_folder, shared_dir, stage

LABEL = "label"
VECTOR = "features"
PREDICTION = "predicted_points"


def assembled(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Add the feature vector."""
    inputs = [PREFIX + name for name in features]
    assembler = VectorAssembler(inputCols=inputs, outputCol=VECTOR, handleInvalid="error")
    return assembler.transform(with_features(df, features)).drop(*inputs)


def with_label(df: DataFrame, target: str = "points_per_game") -> DataFrame:
    return df.withColumn(LABEL, F.coalesce(F.col(target).cast("double"), F.lit(0.0)))


def draw(key: str = "id", seed: int = 42) -> Column:
    """A number below 2**32 for each key, the same in every engine that has MD5."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def in_training_share(key: str = "id", share: int = 80, seed: int = 42) -> Column:
    """Repeatable row-by-row choice by a hash of the key; it does not depend on partitioning."""
    return draw(key, seed) % 100 < share


def split_rows(
    df: DataFrame, key: str = "id", share: int = 80, seed: int = 42, strata: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows. With ``strata`` each stratum gives its share, rounded down, in the order of the hash."""
    if strata:
        order = "_draw"
        ranked = rank_rows(df.withColumn(order, draw(key, seed)), [F.asc(order), F.asc(key)], strata, "_place").drop(order)
        sizes = stage(ranked.groupBy(*[F.col(name).alias(f"_of_{name}") for name in strata]).agg(F.count(F.lit(1)).alias("_size")), "strata")
        same = F.lit(True)
        for name in strata:
            same = same & F.col(name).eqNullSafe(F.col(f"_of_{name}"))
        df, training = ranked.join(sizes, same), F.col("_place") * 100 <= F.col("_size") * share
        kept = [name for name in ranked.columns if name != "_place"]
        return df.where(training).select(*kept), df.where(~training).select(*kept)
    training = in_training_share(key, share, seed)
    return df.where(training), df.where(~training)


def train(
    df: DataFrame, trees: int = 200, depth: int = 15, leaf: int = 2, seed: int = 42, memory_mb: int = 256, in_tasks: bool = False
) -> RandomForestRegressionModel | forest.Forest:
    """A forest of the given size. ``memory_mb`` bounds the statistics that a task gathers at once: more of it means fewer passes.

    Each task makes statistics for every node of a pass, however few rows it has, so the rows are read by one task for each
    core. The node of each row is kept between the passes, and its lineage is cut in the shared folder every twenty passes.

    ``in_tasks`` grows each tree whole in a task, from draws of its own: for forests of many nodes, whose statistics would take
    most of the time. Above ``forest.MOST_ROWS`` rows, too many for one task, the passes grow them all the same.
    """
    shared_dir(df.sparkSession)
    if in_tasks and 0 < (count := df.count()) <= forest.MOST_ROWS:
        return forest.grow(df, VECTOR, LABEL, PREDICTION, trees, depth, leaf, seed, count)
    rows = df.select(VECTOR, LABEL).coalesce(df.sparkSession.sparkContext.defaultParallelism)
    regressor = RandomForestRegressor(
        featuresCol=VECTOR,
        labelCol=LABEL,
        predictionCol=PREDICTION,
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=leaf,
        featureSubsetStrategy="all",
        seed=seed,
        maxMemoryInMB=memory_mb,
        cacheNodeIds=True,
        checkpointInterval=20,
    )
    return regressor.fit(rows)


def score(model: RandomForestRegressionModel | forest.Forest, df: DataFrame) -> DataFrame:
    return model.transform(df).drop(VECTOR)


def node_table(model: RandomForestRegressionModel) -> DataFrame:
    """(tree, node, left, right, feature, threshold, value) of every node of a saved forest; a leaf has no left or right (-1)."""
    spark = SparkSession.active()
    path = new_folder(spark, "forest")
    model.save(path)
    saved = spark.read.parquet(f"{path}/data")
    node = F.col("nodeData")
    threshold = F.try_element_at(node["split"]["leftCategoriesOrThreshold"], F.lit(1))
    return saved.select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"), threshold.alias("threshold"), node["prediction"].alias("value"),
    )


def walked_predictions(nodes: DataFrame, df: DataFrame, key: str, depth: int) -> DataFrame:
    """(key, walked): the mean over the trees of the leaf that each row ends in, for continuous features.

    Every row is in one node of every tree, and each level is a join with the nodes that moves it on. It checks a model by its nodes alone.
    """
    trees = nodes.agg(F.max("tree")).scalar()
    rows = df.select(F.col(key).alias("_key"), vector_to_array(VECTOR).alias("_x"))
    at = rows.select("_key", "_x", F.explode(F.sequence(F.lit(0), trees)).alias("tree"), F.lit(0).alias("node"))
    down = F.when(F.get("_x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
    for _ in range(depth):
        at = at.join(nodes, ["tree", "node"]).select("_key", "_x", "tree", F.when(F.col("left") < 0, F.col("node")).otherwise(down).alias("node"))
    return at.join(nodes, ["tree", "node"]).groupBy(F.col("_key").alias(key)).agg(F.avg("value").alias("walked"))


def fit_quality(model: RandomForestRegressionModel | forest.Forest, training: DataFrame, testing: DataFrame) -> DataFrame:
    """R² on both shares, one row each."""
    def quality(name: str, df: DataFrame) -> DataFrame:
        return r_squared(model.transform(df), LABEL, PREDICTION).select(F.lit(name).alias("share"), "r2")

    return quality("train", training).unionByName(quality("test", testing))


def importance(model: RandomForestRegressionModel | forest.Forest, features: Sequence[str] = FEATURES, top: int = 5) -> DataFrame:
    """The features with the largest importance; the table has one row per feature."""
    rows = [(name, float(weight)) for name, weight in zip(features, model.featureImportances.toArray())]
    table = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top)


def finish_scores(df: DataFrame) -> DataFrame:
    """Adjustments after scoring: prediction scale, cost in units, expected goals, availability."""
    prediction = numbers.scaled_prediction(F.col(PREDICTION))
    if "chance_of_playing_this_round" in df.columns:
        prediction = numbers.zero_if_unavailable(prediction, F.col("chance_of_playing_this_round"))
    expected = F.col("expected_goals").cast("double") if "expected_goals" in df.columns else F.lit(0.0)
    return df.withColumns(
        {
            PREDICTION: prediction,
            "now_cost": numbers.cost_in_units(F.col("now_cost").cast("double")),
            "expected_goals": numbers.rescaled_expected(expected),
        }
    )
