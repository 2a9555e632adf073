"""Training a forest of bounded depth level by level, as a model of Spark ML.

The rule is Spark ML's: every tree draws rows with Poisson(1) counts, a node
tries ``FEATURES_PER_SPLIT`` features drawn for it, the cut with the largest
gain in Gini impurity that leaves ``min_leaf`` draws on both sides is taken, a
node without one is a leaf, and two leaves with the same prediction are one.

What differs is where the work is done. Draws follow from a hash of row and
tree, so no row carries its counts of all trees. For every level, each task
leads its rows down all trees, one tree after the other over a block of rows, so
that a tree's histogram stays in the processor's cache, and hands on one array
per tree. Arrays of a tree meet in one task, which adds them up and chooses the
cuts. Equal rows share a record, which is walked once (``forest_trainer``).
The driver holds the model, as Spark ML's does: its nodes follow from number and
depth of the trees, not from the rows.

Defined cases: an empty table, a missing or infinite feature, a class other than
0, 1, 2 and different weights within a class are refused; repeated rows draw one
by one, whatever their keys; a tree that drew nothing is one leaf that knows
nothing.
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.codebook import FEATURES, TARGET
from vitalgrid.functions.settle import settled
from vitalgrid.operators.forest_trainer import MAX_BINS, N_CLASSES, Open, Profiles, best_cuts, child_keys, cuts_of, feature_order, node_of, prepared
from vitalgrid.session import run_folder, written

# The helpers below travel with the task, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells of histograms that a task holds at once (24 bytes each); trees that need more take several passes.
CELLS = 2_000_000
#: Records that are led down a tree together.
BLOCK = 8192


class Tree:
    """One tree: its nodes so far, in arrays, and the nodes that may be split next. A node that is not split leads to itself."""

    def __init__(self) -> None:
        self.feature, self.bin = np.zeros(1, np.int64), np.full(1, 255)
        self.left, self.right, self.key = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.draws, self.gain = np.zeros((1, N_CLASSES), np.int64), np.full(1, -1.0)
        self.open = np.zeros(1, np.int64)

    def split(self, at: np.ndarray, feature: np.ndarray, place: np.ndarray, gain: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Split nodes; gives their children, which know their draws."""
        first = len(self.feature) + 2 * np.arange(len(at))
        new = np.arange(len(self.feature), len(self.feature) + 2 * len(at))
        self.feature[at], self.bin[at], self.gain[at] = feature, place, gain
        self.left[at], self.right[at] = first, first + 1
        keys = np.stack([child_keys(self.key[at], 0), child_keys(self.key[at], 1)], axis=1).reshape(-1)
        draws = np.stack([left, self.draws[at] - left], axis=1).reshape(-1, N_CLASSES)
        fresh = {"feature": np.zeros(len(new), np.int64), "bin": np.full(len(new), 255), "left": new, "right": new, "key": keys, "draws": draws, "gain": np.full(len(new), -1.0)}
        for name, values in fresh.items():
            setattr(self, name, np.concatenate([getattr(self, name), values]))
        return new

    def folded(self, weights: np.ndarray) -> None:
        """Two leaves with the same prediction become one, from the bottom up."""
        predicted = np.argmax(self.draws * weights, axis=1)
        leaf = self.left == np.arange(len(self.left))
        for at in np.flatnonzero(~leaf)[::-1]:
            a, b = self.left[at], self.right[at]
            if leaf[a] and leaf[b] and predicted[a] == predicted[b]:
                predicted[at], leaf[at] = predicted[a], True
                self.left[at] = self.right[at] = at
                self.gain[at] = -1.0
        self.predicted = predicted

    def in_order(self) -> np.ndarray:
        """Its nodes, each before those of its left side, and these before those of its right."""
        found, waiting = [], [0]
        while waiting:
            at = waiting.pop()
            found.append(at)
            if self.left[at] != at:
                waiting += [self.right[at], self.left[at]]
        return np.array(found)


def purity(a: np.ndarray) -> np.ndarray:
    """Squared class weights over all weight, per row of ``a``; 0 without weight."""
    return (a * a).sum(axis=1) / np.maximum(a.sum(axis=1), 1e-300)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches in blocks of ``BLOCK`` records or a little more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def level(rows: DataFrame, trees: dict[int, Tree], depth: int, bins: np.ndarray, weights: np.ndarray, min_leaf: int) -> DataFrame:
    """Per tree the draws of its open nodes, and the cuts that were chosen for them."""
    state = {t: (tree.feature, tree.bin, tree.left, tree.right, tree.open, tree.key[tree.open]) for t, tree in trees.items()}
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def opened(t: int) -> Open:
        keys = shared.value[t][5]
        return Open(feature_order(np.full(len(keys), t), keys), np.zeros(len(keys), np.int64), bins)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for t, (feature, place, left, right, at, _) in shared.value.items():
            number, open_ = np.full(len(feature), -1), opened(t)
            number[at] = np.arange(len(at))
            held[t] = ((feature, place, left, right, depth), number, open_, np.zeros(open_.cells * N_CLASSES))
        for block in gathered(batches):
            profiles = Profiles(block)
            flat = profiles.x.reshape(-1)
            for t, (top, number, open_, total) in held.items():
                times = profiles.times(t)
                own = np.flatnonzero(times)
                node = number[node_of(top, profiles.x, own)]
                inside = np.flatnonzero(node >= 0)
                own, node = own[inside], node[inside]
                cell = open_.start[node] + flat[(own * len(FEATURES))[:, None] + open_.features[node]]
                cell = cell * N_CLASSES + profiles.label[own][:, None]
                total += np.bincount(cell.reshape(-1), weights=np.repeat(times[own], cell.shape[1]), minlength=len(total))
        for t, (_, _, _, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["tree", "cells"])

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        t = key[0].as_py()
        open_ = opened(t)
        cells = sum(np.frombuffer(c, "<i8") for c in table["cells"].to_pylist()).reshape(-1, N_CLASSES)
        # a node's first feature has all its draws
        first = open_.start[:, 0]
        upto = np.concatenate([np.zeros((1, N_CLASSES), np.int64), np.cumsum(cells, axis=0)])
        whole = upto[first + bins[open_.features[:, 0]]] - upto[first]
        both = np.stack([cells, cells], axis=2).astype(float)
        node, feature, place, left = best_cuts(both, open_, np.tile(weights, (len(first), 1)), min_leaf)
        lists = [[v.astype(np.int64).reshape(-1)] for v in (whole, node, feature, place, left[:, :, 1])]
        return pa.table([pa.array([t], pa.int64()), *[pa.array(v, pa.list_(pa.int64())) for v in lists]], names=["tree", *_CHOSEN])

    schema = "tree bigint, " + ", ".join(f"{c} array<bigint>" for c in _CHOSEN)
    return rows.mapInArrow(count, "tree bigint, cells binary").groupBy("tree").applyInArrow(choose, schema)


_CHOSEN = ("whole", "node", "feature", "bin", "left")


def grown(rows: DataFrame, trees: int, depth: int, bins: np.ndarray, weights: np.ndarray, min_leaf: int) -> dict[int, Tree]:
    """All trees of a forest over written records (``forest_trainer.prepared``)."""
    forest = {t: Tree() for t in range(trees)}
    for d in range(depth + 1):
        for part in _passes({t: tree for t, tree in forest.items() if len(tree.open)}, bins):
            for r in level(rows, part, d, bins, weights, min_leaf).toArrow().to_pylist():
                _settle(forest[r["tree"]], r, weights, d == depth, min_leaf)
    for tree in forest.values():
        tree.folded(weights)
    return forest


def _settle(tree: Tree, r: dict, weights: np.ndarray, last: bool, min_leaf: int) -> None:
    """Split the open nodes for which a cut was chosen; their children are open if a cut may be found for them."""
    if len(tree.feature) == 1:
        tree.draws = np.array(r["whole"], np.int64).reshape(1, N_CLASSES)
    at, left = tree.open[np.array(r["node"], np.int64)], np.array(r["left"], np.int64).reshape(-1, N_CLASSES)
    whole, a = tree.draws[at] * weights, left * weights
    gain = (purity(a) + purity(whole - a) - purity(whole)) / whole.sum(axis=1)
    keep = np.flatnonzero((gain > 0) & (not last))
    new = tree.split(at[keep], np.array(r["feature"], np.int64)[keep], np.array(r["bin"], np.int64)[keep], gain[keep], left[keep])
    mixed = (tree.draws[new] > 0).sum(axis=1) > 1
    tree.open = new[mixed & (tree.draws[new].sum(axis=1) >= 2 * min_leaf)]


def _passes(trees: dict[int, Tree], bins: np.ndarray) -> Iterator[dict[int, Tree]]:
    """Trees in parts whose histograms a task can hold."""
    most, part, cells = int(np.sort(bins)[-4:].sum()), {}, 0
    for t, tree in trees.items():
        if part and cells + most * len(tree.open) > CELLS:
            yield part
            part, cells = {}, 0
        part[t] = tree
        cells += most * len(tree.open)
    if part:
        yield part


def fitted(estimator: RandomForestClassifier, dataset: DataFrame) -> RandomForestClassificationModel:
    """The forest that ``estimator``'s parameters ask for, trained on ``dataset``."""
    label, weight = F.col(estimator.getLabelCol()).alias(TARGET), F.col(estimator.getWeightCol()).alias("_weight")
    # written, because four passes follow: the vector of a row is taken apart once
    apart = settled(dataset.select(label, weight, F.monotonically_increasing_id().alias("_place"), F.col(estimator.getFeaturesCol()).alias("_all")), {"_values": vector_to_array("_all")})
    rows = written(apart.select(TARGET, "_weight", "_place", *[F.get("_values", F.lit(i)).alias(f) for i, f in enumerate(FEATURES)]))
    weights = np.zeros(N_CLASSES)
    found = rows.groupBy(TARGET).agg(F.min("_weight").alias("low"), F.max("_weight").alias("high")).collect()
    if not found:
        raise ValueError("no rows to train on")
    for r in found:
        if r["low"] is None or r["low"] != r["high"]:
            raise ValueError("rows of one class must have one weight")
        if r[TARGET] in range(N_CLASSES):
            weights[int(r[TARGET])] = r["low"]
    cuts = cuts_of(rows, min(MAX_BINS, estimator.getMaxBins()))
    records = prepared(rows, cuts, "_place", estimator.getSeed())
    forest = grown(records, estimator.getNumTrees(), estimator.getMaxDepth(), cuts.bins, weights, estimator.getMinInstancesPerNode())
    return _model(dataset.sparkSession, estimator, forest, cuts.points, weights)


def _model(spark: SparkSession, estimator: RandomForestClassifier, forest: dict[int, Tree], points: list[np.ndarray], weights: np.ndarray) -> RandomForestClassificationModel:
    """The trees as a model of Spark ML, by way of the files it saves models in."""
    path = run_folder(spark)
    edges = np.concatenate([*points, [0.0]])
    begins = np.cumsum([0, *[len(p) for p in points]])
    columns: dict[str, list] = {c: [] for c in ("tree", "id", "prediction", "impurity", "stats", "count", "gain", "left", "right", "feature", "threshold")}
    for t, tree in forest.items():
        at = tree.in_order()
        place = np.full(len(tree.left), -1)
        place[at] = np.arange(len(at))
        leaf, stats = tree.left[at] == at, tree.draws[at] * weights
        total = np.maximum(stats.sum(axis=1), 1e-300)
        new = {
            "tree": np.full(len(at), t), "id": np.arange(len(at)), "prediction": tree.predicted[at].astype(float),
            "impurity": np.where(stats.sum(axis=1) > 0, 1 - purity(stats) / total, 0.0), "stats": stats.reshape(-1), "count": tree.draws[at].sum(axis=1),
            "gain": tree.gain[at], "left": np.where(leaf, -1, place[tree.left[at]]), "right": np.where(leaf, -1, place[tree.right[at]]),
            "feature": np.where(leaf, -1, tree.feature[at]), "threshold": edges[np.where(leaf, -1, begins[tree.feature[at]] + tree.bin[at])],
        }
        for c, v in new.items():
            columns[c].append(v)
    c = {k: np.concatenate(v) for k, v in columns.items()}
    n, inner = len(c["tree"]), c["feature"] >= 0
    threshold = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(inner)).astype(np.int32)), pa.array(c["threshold"][inner]))
    stats = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * N_CLASSES), pa.array(c["stats"]))
    ints = {k: pa.array(c[k].astype(np.int32)) for k in ("tree", "id", "left", "right", "feature")}
    split = pa.StructArray.from_arrays([ints["feature"], threshold, pa.array(np.full(n, -1, np.int32))], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    node = pa.StructArray.from_arrays(
        [ints["id"], pa.array(c["prediction"]), pa.array(c["impurity"]), stats, pa.array(c["count"]), pa.array(c["gain"]), ints["left"], ints["right"], split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"],
    )
    spark.createDataFrame(pa.table({"treeID": ints["tree"], "nodeData": node})).write.parquet(f"{path}/data")
    own = {p.name: estimator.getOrDefault(p) for p in estimator.params if estimator.isSet(p)}
    about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    tree_params = {k: own[k] for k in ("featuresCol", "labelCol", "maxDepth", "impurity") if k in own}
    kinds = "org.apache.spark.ml.classification."
    each = [
        (t, json.dumps({"class": kinds + "DecisionTreeClassificationModel", **about, "uid": f"{estimator.uid}_{t}", "paramMap": tree_params, "defaultParamMap": {}}), 1.0)
        for t in forest
    ]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole = {
        "class": kinds + "RandomForestClassificationModel", **about, "uid": estimator.uid, "paramMap": own, "defaultParamMap": {},
        "numFeatures": len(FEATURES), "numClasses": N_CLASSES, "numTrees": len(forest),
    }
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)
