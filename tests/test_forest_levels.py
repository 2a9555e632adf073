"""The forest of bounded depth against plain counting, and as a model of Spark ML."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from vitalgrid.codebook import FEATURES, TARGET
from vitalgrid.operators import forest, forest_levels
from vitalgrid.operators.forest_trainer import child_keys, cuts_of, draws, feature_order, prepared
from vitalgrid.plans.derived import survey
from vitalgrid.session import run_folder
from vitalgrid.sources.artifacts import save_model

WEIGHTS = np.array([0.4, 9.0, 2.5])


def gini(n):
    return 1 - ((n * WEIGHTS) ** 2).sum() / (n * WEIGHTS).sum() ** 2


def plain_tree(x, label, times, tree, depth, min_leaf):
    """``draws, feature, bin, left, right`` of the root, by trying every cut on the drawn rows; leaves have None."""

    def node(rows, key, level):
        n = np.array([times[rows][label[rows] == c].sum() for c in range(3)])
        found = None
        if level < depth and (n > 0).sum() > 1 and n.sum() >= 2 * min_leaf:
            for f in sorted(feature_order(np.array([tree]), np.array([key]))[0][:4]):
                for place in sorted(set(x[rows, f].tolist()))[:-1]:
                    left = rows[x[rows, f] <= place]
                    a = np.array([times[left][label[left] == c].sum() for c in range(3)])
                    if min(a.sum(), (n - a).sum()) < min_leaf:
                        continue
                    wa, wb = (a * WEIGHTS).sum(), ((n - a) * WEIGHTS).sum()
                    gain = gini(n) - (wa * gini(a) + wb * gini(n - a)) / (wa + wb)
                    if gain > 1e-9 and (found is None or gain > found[0] + 1e-12):
                        found = (gain, int(f), int(place), left, rows[x[rows, f] > place])
        if found is None:
            return (n.tolist(), None, None, None, None)
        below = [node(part, int(child_keys(np.array([key]), side)[0]), level + 1) for side, part in enumerate(found[3:])]
        if all(b[1] is None for b in below) and len({int(np.argmax(np.array(b[0]) * WEIGHTS)) for b in below}) == 1:
            return (n.tolist(), None, None, None, None)
        return (n.tolist(), found[1], found[2], *below)

    return node(np.flatnonzero(times), 0, 0)


def as_plain(tree, at=0):
    if tree.left[at] == at:
        return (tree.draws[at].tolist(), None, None, None, None)
    return (tree.draws[at].tolist(), int(tree.feature[at]), int(tree.bin[at]), as_plain(tree, tree.left[at]), as_plain(tree, tree.right[at]))


def test_trees_equal_plain_counting(spark, tiny, monkeypatch):
    rows = survey(spark, tiny).filter("rid < 400")
    rows = rows.unionByName(rows.filter("rid < 50")).unionByName(rows.filter("rid < 20")).withColumn("_place", F.monotonically_increasing_id())
    cuts = cuts_of(rows)
    records = prepared(rows, cuts, "_place", 5)
    monkeypatch.setattr(forest_levels, "BLOCK", 64)
    monkeypatch.setattr(forest_levels, "CELLS", 500)
    got = forest_levels.grown(records, 4, 5, cuts.bins, WEIGHTS, 2)
    held = records.collect()
    code = [np.frombuffer(r["codes"], "<u4") for r in held]
    x = np.array([list(r["bins"]) for r, c in zip(held, code) for _ in c])
    label = np.array([r["label"] for r, c in zip(held, code) for _ in c])
    assert len(held) < len(label) == 470
    for t in range(4):
        want = plain_tree(x, label, draws(np.concatenate(code), t).astype(int), t, 5, 2)
        assert as_plain(got[t]) == want and want[1] is not None


def test_rows_do_not_go_through_all_trees_of_spark_ml(spark, tiny, monkeypatch):
    """Spark ML's own trainer keeps a count per tree with every row and meets the nodes of all trees for each: it is not asked."""
    monkeypatch.setattr(RandomForestClassifier, "_fit_java", None)
    rows = survey(spark, tiny)
    model = forest.train(rows, trees=6, depth=4)
    assert (model.getNumTrees, model.numClasses, model.numFeatures, model.getMaxDepth()) == (6, 3, len(FEATURES), 4)
    path = run_folder(spark)
    save_model(model, path)
    nodes = forest.saved_nodes(spark, path)
    assert nodes.select("tree").distinct().count() == 6
    # every split adds up, and two leaves of one prediction are never side by side
    found = {(r["tree"], r["node"]): r for r in nodes.collect()}
    for (t, _), r in found.items():
        if r["left_node"] >= 0:
            a, b = found[t, r["left_node"]], found[t, r["right_node"]]
            assert np.array(a["weights"]) + np.array(b["weights"]) == pytest.approx(np.array(r["weights"]))
            assert a["left_node"] >= 0 or b["left_node"] >= 0 or np.argmax(a["weights"]) != np.argmax(b["weights"])
    scored = forest.score_with_model(rows, model)
    right = F.avg((F.col("predicted_class") == F.col(TARGET)).cast("int")).alias("right")
    classes = [r["right"] for r in scored.groupBy(TARGET).agg(right).collect()]
    assert sum(classes) > 1.5


def test_repeated_keys_draw_apart_and_odd_tables_are_refused(spark, tiny):
    rows = survey(spark, tiny).filter("rid < 300")
    apart = forest.train(rows.withColumn("rid", F.lit(None).cast("bigint")), trees=2, depth=2)
    assert apart.totalNumNodes > 2
    with pytest.raises(ValueError):
        forest.train(rows.limit(0), trees=1, depth=1)
    with pytest.raises(Exception, match="missing|null|NaN|Null"):
        forest.train(rows.withColumn("BMI", F.when(F.col("rid") != 7, F.col("BMI"))), trees=1, depth=1)
