"""Training, scoring and the tree structure of the three-class forest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.codebook import FEATURES, TARGET
from vitalgrid.functions.settle import settled
from vitalgrid.functions.risk import class_label, first_largest, probability_of
from vitalgrid.operators import forest_levels
from vitalgrid.operators.split import with_weights

N_CLASSES = 3
# Leaves up to which a forest is written out as nested conditions; larger ones are walked as arrays.
EXPRESSION_LEAVES = 1024


@dataclass(frozen=True)
class Node:
    """One node: inner nodes have children and a split, leaves have neither."""

    cover: float
    weights: tuple[float, ...]
    feature: str | None = None
    threshold: float | None = None
    left: "Node | None" = None
    right: "Node | None" = None

    @property
    def is_leaf(self) -> bool:
        return self.left is None


@dataclass(frozen=True)
class Leaf:
    """One leaf: interval ``(low, high]`` and cover share per distinct path feature."""

    tree: int
    value: tuple[float, ...]
    low: dict[str, float] = field(default_factory=dict)
    high: dict[str, float] = field(default_factory=dict)
    share: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Forest:
    trees: tuple[Node, ...]

    def leaves(self) -> list[Leaf]:
        """All leaves; ``value`` is the leaf's class shares divided by the number of trees."""
        found: list[Leaf] = []
        for number, root in enumerate(self.trees):
            open_nodes = [(root, Leaf(number, ()))]
            while open_nodes:
                node, path = open_nodes.pop()
                if node.is_leaf:
                    whole = sum(node.weights)
                    value = tuple(w / whole / len(self.trees) for w in node.weights)
                    found.append(Leaf(number, value, path.low, path.high, path.share))
                    continue
                name, cut = node.feature, node.threshold
                for child, is_left in ((node.left, True), (node.right, False)):
                    low, high, share = dict(path.low), dict(path.high), dict(path.share)
                    low.setdefault(name, float("-inf"))
                    high.setdefault(name, float("inf"))
                    if is_left:
                        high[name] = min(high[name], cut)
                    else:
                        low[name] = max(low[name], cut)
                    # a feature met twice on one path keeps one merged share
                    share[name] = share.get(name, 1.0) * child.cover / node.cover
                    open_nodes.append((child, Leaf(number, (), low, high, share)))
        return found

    def base_values(self) -> list[float]:
        """Expected class probabilities over the cover: where contributions start from."""
        base = [0.0] * N_CLASSES
        for leaf in self.leaves():
            reach = 1.0
            for part in leaf.share.values():
                reach *= part
            base = [b + reach * v for b, v in zip(base, leaf.value)]
        return base

    def probabilities(self) -> Column:
        """Mean class shares over the trees: one expression, or an Arrow column for large forests."""
        if sum(_leaf_count(root) for root in self.trees) > EXPRESSION_LEAVES:
            return _walked(self)
        per_tree = [_tree_expression(root) for root in self.trees]
        return F.array(
            *[
                sum((tree[c] for tree in per_tree[1:]), per_tree[0][c]) / float(len(self.trees))
                for c in range(N_CLASSES)
            ]
        )


def _leaf_count(node: Node) -> int:
    return 1 if node.is_leaf else _leaf_count(node.left) + _leaf_count(node.right)


class FlatTrees:
    """All nodes of a forest in arrays; leaves point to themselves, so a walk may go on past them."""

    def __init__(self, forest: Forest) -> None:
        feature, threshold, left, right, shares, self.roots, self.depth = [], [], [], [], [], [], 0
        for root in forest.trees:
            self.roots.append(len(feature))
            open_nodes, level = [(root, -1, "", 0)], 0
            while open_nodes:
                node, parent, side, level = open_nodes.pop()
                at = len(feature)
                if parent >= 0:
                    (left if side == "l" else right)[parent] = at
                whole = sum(node.weights) or 1.0
                feature.append(0 if node.is_leaf else FEATURES.index(node.feature))
                threshold.append(0.0 if node.is_leaf else node.threshold)
                left.append(at)
                right.append(at)
                shares.append([w / whole for w in node.weights] if node.is_leaf else [0.0] * N_CLASSES)
                self.depth = max(self.depth, level)
                if not node.is_leaf:
                    open_nodes += [(node.right, at, "r", level + 1), (node.left, at, "l", level + 1)]
        self.feature, self.threshold = np.array(feature), np.array(threshold)
        self.left, self.right, self.shares = np.array(left), np.array(right), np.array(shares)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Mean class shares of rows of 21 values, one pass per tree and level over all rows."""
        total, rows = np.zeros((len(x), N_CLASSES)), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.shares[node]
        return total / len(self.roots)


def _walked(forest: Forest) -> Column:
    shared = SparkSession.active().sparkContext.broadcast(FlatTrees(forest))

    @F.arrow_udf("array<double>")
    def walk(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
            offsets = pa.array(np.arange(0, len(x) * N_CLASSES + 1, N_CLASSES, dtype=np.int32))
            yield pa.ListArray.from_arrays(offsets, pa.array(shared.value.probabilities(x).reshape(-1)))

    return walk(*[F.col(f) for f in FEATURES])


def _tree_expression(node: Node) -> list[Column]:
    """Class shares of the leaf a row falls into, one column per class."""
    if node.is_leaf:
        whole = sum(node.weights)
        return [F.lit(w / whole) for w in node.weights]
    left, right = _tree_expression(node.left), _tree_expression(node.right)
    goes_left = F.col(node.feature) <= F.lit(node.threshold)
    return [F.when(goes_left, a).otherwise(b) for a, b in zip(left, right)]


def score(df: DataFrame, forest: Forest) -> DataFrame:
    """Add ``probabilities``, ``predicted_class`` and ``high_risk_probability``."""
    probabilities = forest.probabilities()
    if sum(_leaf_count(root) for root in forest.trees) > EXPRESSION_LEAVES:
        return with_prediction(df.withColumn("probabilities", probabilities))
    return with_prediction(settled(df, {"probabilities": probabilities}))


def with_prediction(df: DataFrame) -> DataFrame:
    """Columns that follow from ``probabilities``."""
    probabilities = F.col("probabilities")
    return df.withColumns(
        {
            "predicted_class": first_largest(probabilities),
            "high_risk_probability": probability_of(probabilities, 2),
        }
    ).withColumn("predicted_label", class_label(F.col("predicted_class")))


# --- Spark ML -----------------------------------------------------------------


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="_vector", handleInvalid="error")


class LevelForestClassifier(RandomForestClassifier):
    """Spark ML's estimator and model; its trees are trained by ``forest_levels``."""

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        return self._copyValues(forest_levels.fitted(self, dataset))


def train(
    df: DataFrame,
    trees: int = 400,
    depth: int = 10,
    min_leaf: int = 2,
    seed: int = 42,
    max_bins: int = 128,
) -> RandomForestClassificationModel:
    """Balanced forest on cleaned training rows.

    Four features per split is the square root rule of 21 features; class
    imbalance enters as a weight per row. Spark ML caps the depth at 30 and bins
    values (BMI has 89 whole-number values, so 128 bins lose nothing on it).
    """
    rows = assembler().transform(with_weights(df)).select(F.col(TARGET).cast("double").alias("label"), "_vector", "weight")
    return LevelForestClassifier(
        featuresCol="_vector",
        labelCol="label",
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        impurity="gini",
        featureSubsetStrategy="4",
        maxBins=max_bins,
        seed=seed,
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        predictionCol="_prediction",
    ).fit(rows)


def score_with_model(df: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Same columns as ``score``, from a trained model."""
    scored = model.transform(assembler().transform(df))
    return with_prediction(
        scored.withColumn("probabilities", vector_to_array("_probability")).drop(
            "_vector", "_raw", "_probability", "_prediction"
        )
    )


def saved_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node table of a saved model: one row per (tree, node)."""
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        n["id"].alias("node"),
        n["leftChild"].alias("left_node"),
        n["rightChild"].alias("right_node"),
        n["split"]["featureIndex"].alias("feature_index"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        n["impurityStats"].alias("weights"),
    )


def forest_from_nodes(nodes: DataFrame) -> Forest:
    """The tree structure of a node table: as large as the model, whatever the number of rows it was trained on."""
    table: dict[int, dict[int, object]] = {}
    for row in nodes.toLocalIterator():
        table.setdefault(row["tree"], {})[row["node"]] = row

    def build(rows, number: int) -> Node:
        row = rows[number]
        weights = tuple(row["weights"])
        if row["left_node"] < 0:
            return Node(sum(weights), weights)
        return Node(
            sum(weights),
            weights,
            FEATURES[row["feature_index"]],
            row["threshold"],
            build(rows, row["left_node"]),
            build(rows, row["right_node"]),
        )

    return Forest(tuple(build(rows, 0) for _, rows in sorted(table.items())))
