"""A random-forest regressor whose trees are grown whole in tasks.

MLlib grows all trees at once, level by level: each task sends statistics of every node to the task that picks its split, and the
driver holds all nodes. A forest of many small nodes is mostly such statistics. Here each task gets the rows as bins of their
features, some bytes each, and grows trees of its own from them. Bins, draws, splits and stops are MLlib's: up to 32 bins found on a
sample, a Poisson weight of mean 1 for each row and tree, the split with the largest fall in variance over all features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import stage

BINS = 32
#: Bins are found on so many rows, as MLlib does.
SAMPLED = max(BINS * BINS, 10_000)
#: A task that grows trees holds all training rows, with some 120 bytes each while it works on a tree.
MOST_ROWS = 2**22
_GROWN = "tree int, feature binary, threshold binary, left binary, value binary, gains binary"


class Forest:
    """Grown trees. Their nodes are at most trees * 2**(depth + 1), whatever the rows, of 24 bytes each; tasks get them by one broadcast."""

    def __init__(self, grown: DataFrame, size: int, features: str, prediction: str):
        self._features, self._prediction = features, prediction
        rows = sorted(grown.toLocalIterator(), key=lambda row: row["tree"])
        kinds = (("feature", "i4"), ("threshold", "f8"), ("left", "i4"), ("value", "f8"))
        self.trees = [tuple(np.frombuffer(row[name], kind) for name, kind in kinds) for row in rows]
        total = np.zeros(size)
        for gains in (np.frombuffer(row["gains"]) for row in rows):
            total += gains / (gains.sum() or 1.0)
        self.featureImportances = DenseVector(total / (total.sum() or 1.0))
        self._sent = grown.sparkSession.sparkContext.broadcast(self.trees)

    @property
    def totalNumNodes(self) -> int:
        return sum(len(value) for *_, value in self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the prediction, the mean over the trees of the leaf a row ends in."""
        return df.withColumn(self._prediction, self._predicted()(vector_to_array(self._features)))

    def _predicted(self) -> Callable[[Column], Column]:
        sent = self._sent

        @F.arrow_udf("double")
        def predicted(vectors: pa.Array) -> pa.Array:
            rows = _matrix(vectors)
            return pa.array(sum((walk(tree, rows) for tree in sent.value), np.zeros(len(rows))) / len(sent.value))

        return predicted


def grow(df: DataFrame, features: str, label: str, prediction: str, trees: int, depth: int, leaf: int, seed: int, rows: int) -> Forest:
    """A forest of ``trees`` from the vectors and labels of ``df``, which has ``rows`` rows and gives the same at each read.

    A tree depends on the seed, its number and the order of the rows, so how many tasks there are changes none.
    """
    data = df.select(vector_to_array(features).alias("x"), F.col(label).alias("y"))
    sample = data if rows <= SAMPLED else data.sample(SAMPLED / rows, seed)
    bins = [list(row["cuts"]) for row in sample.select("x").repartition(1).mapInArrow(_cuts, "feature int, cuts array<double>").orderBy("feature").collect()]
    tasks = min(trees, 2 * df.sparkSession.sparkContext.defaultParallelism)
    packed = stage(data.mapInArrow(_packing(bins), "codes binary, labels binary").withColumn("block", F.monotonically_increasing_id()), "binned")
    dealt = packed.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, F.col("task"))
    grown = stage(dealt.mapInArrow(_growing(bins, trees, tasks, depth, leaf, seed), _GROWN), "trees")
    return Forest(grown, len(bins), features, prediction)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cuts of every feature, from all rows of the sample."""
    parts = [_matrix(batch.column(0)) for batch in batches if batch.num_rows]
    if parts:
        cuts = [cuts_of(column) for column in np.concatenate(parts).T]
        yield pa.record_batch({"feature": pa.array(range(len(cuts)), pa.int32()), "cuts": pa.array(cuts, pa.list_(pa.float64()))})


def cuts_of(values: np.ndarray) -> list[float]:
    """Between all values when there are few, else where about as many values of the sample are on each side of the next cut."""
    found, counts = np.unique(values, return_counts=True)
    between = (found[:-1] + found[1:]) / 2
    if len(between) < BINS:
        return between.tolist()
    stride = len(values) / BINS
    below, goal, cuts = np.cumsum(counts), stride, []
    for n in range(1, len(found)):
        if abs(below[n - 1] - goal) < abs(below[n] - goal):
            cuts.append(float(between[n - 1]))
            goal += stride
    return cuts


def _packing(bins: Sequence[Sequence[float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = coded(_matrix(batch.column(0)), bins)
                labels = batch.column(1).to_numpy(zero_copy_only=False)
                yield pa.record_batch({"codes": pa.array([codes.tobytes()], pa.binary()), "labels": pa.array([labels.tobytes()], pa.binary())})

    return pack


def coded(rows: np.ndarray, bins: Sequence[Sequence[float]]) -> np.ndarray:
    """The bin of every row, for each feature that has a cut: the number of cuts below its value."""
    varied = [np.searchsorted(cuts, rows[:, n]).astype(np.uint8) for n, cuts in enumerate(bins) if len(cuts)]
    return np.stack(varied) if varied else np.empty((0, len(rows)), np.uint8)


def _growing(
    bins: Sequence[Sequence[float]], trees: int, tasks: int, depth: int, leaf: int, seed: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [row for batch in batches for row in batch.to_pylist()]
        if not blocks:
            return
        blocks.sort(key=lambda row: row["block"])
        labels = np.concatenate([np.frombuffer(row["labels"]) for row in blocks])
        codes = np.concatenate([np.frombuffer(row["codes"], np.uint8).reshape(-1, len(row["labels"]) // 8) for row in blocks], axis=1)
        first = blocks[0]["task"]
        blocks.clear()
        for tree in range(first, trees, tasks):
            weights = np.random.default_rng([seed, tree]).poisson(1.0, len(labels))
            made = grown_tree(codes, labels, weights, bins, depth, leaf)
            yield pa.record_batch({"tree": pa.array([tree], pa.int32())} | {name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("feature", "threshold", "left", "value", "gains"), made)})

    return work


def grown_tree(
    codes: np.ndarray, labels: np.ndarray, weights: np.ndarray, bins: Sequence[Sequence[float]], depth: int, leaf: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, threshold, left, value) of every node and the gains of every feature. The right child follows the left one.

    A leaf is its own left child, beyond all values. Each level is split at once, one feature after another, over counts and sums of
    the labels by node and bin; labels count from their mean, which loses no digits of gains.
    """
    varied = [n for n, cuts in enumerate(bins) if len(cuts)]
    mean = np.average(labels, weights=weights) if weights.any() else 0.0
    rows = np.flatnonzero(weights)
    y, w, own = labels[rows] - mean, weights[rows].astype(np.float64), codes[:, rows]
    slot, nodes = np.zeros(len(rows), np.int64), 1
    gains, made, total = np.zeros(len(bins)), [], 1
    for level in range(depth + 1):
        wy = w * y
        count, summed = np.bincount(slot, w, nodes), np.bincount(slot, wy, nodes)
        value = np.divide(summed, count, out=np.zeros(nodes), where=count > 0)
        feature, cut = np.full(nodes, -1, np.int64), np.zeros(nodes, np.int64)
        if level < depth and len(slot):
            low, high = np.full(nodes, np.inf), np.full(nodes, -np.inf)
            np.minimum.at(low, slot, y)
            np.maximum.at(high, slot, y)
            # One label in all rows of a node is no gain, whatever the rounding of its sums.
            best, every, undivided = np.where(low < high, 0.0, np.inf), np.arange(nodes), summed * value
            for n, name in enumerate(varied):
                gain = _split_gains(slot, own[n], w, wy, count[:, None], summed[:, None], len(bins[name]) + 1, leaf)
                place = gain.argmax(axis=1)
                found = gain[every, place] - undivided
                better = found > best
                best[better], feature[better], cut[better] = found[better], name, place[better]
            gains += np.bincount(feature[feature >= 0], best[feature >= 0], len(bins))
        split = feature >= 0
        # Children stand behind this level, in pairs.
        behind = np.cumsum(split) - 1
        left_child = np.where(split, total + 2 * behind, total - nodes + np.arange(nodes))
        threshold = np.array([bins[f][c] if f >= 0 else np.inf for f, c in zip(feature.tolist(), cut.tolist())])
        made.append((np.maximum(feature, 0).astype("i4"), threshold, left_child.astype("i4"), value + mean))
        if not split.any():
            break
        stays = split[slot]
        y, w, slot, own = y[stays], w[stays], slot[stays], own[:, stays]
        order = np.full(len(bins), -1)
        order[varied] = np.arange(len(varied))
        slot = 2 * behind[slot] + (own[order[feature[slot]], np.arange(len(slot))] > cut[slot])
        nodes = 2 * int(split.sum())
        total += nodes
    return *(np.concatenate(part) for part in zip(*made)), gains


def _split_gains(
    slot: np.ndarray, code: np.ndarray, w: np.ndarray, wy: np.ndarray, count: np.ndarray, summed: np.ndarray, wide: int, leaf: int
) -> np.ndarray:
    """By node and cut of one feature, what the squares of the sums of both sides come to; none where a side has too few rows."""
    at, shape = slot * wide + code, (len(count), wide)
    left = np.cumsum(np.bincount(at, w, len(count) * wide).reshape(shape)[:, :-1], axis=1)
    left_sum = np.cumsum(np.bincount(at, wy, len(count) * wide).reshape(shape)[:, :-1], axis=1)
    right, right_sum = count - left, summed - left_sum
    few = np.minimum(left, right) < max(leaf, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        left_sum *= left_sum
        left_sum /= left
        right_sum *= right_sum
        right_sum /= right
    left_sum += right_sum
    left_sum[few] = -np.inf
    return left_sum


def walk(tree: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row ends in."""
    feature, threshold, left, value = tree
    flat, base = rows.ravel(), np.arange(len(rows)) * rows.shape[1]
    node = np.zeros(len(rows), np.int32)
    while True:
        below = left[node] + (flat[base + feature[node]] > threshold[node])
        if (below == node).all():
            return value[node]
        node = below
