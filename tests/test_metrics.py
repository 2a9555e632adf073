import random

import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import metrics

# published totals: support, predicted and true positives per class
SUPPORT, PREDICTED, TRUE = (42741, 926, 7069), (42857, 152, 7727), (38384, 1, 3200)
GOLDEN = {
    "accuracy": 0.8196349731945758, "balanced_accuracy": 0.4506070142054485,
    "macro_f1": 0.4437493364732065, "weighted_f1": 0.8158189914048523,
}


def cells_with_marginals(spark):
    """Any nine cells with the published row and column totals."""
    # off-diagonal cells solve the totals with one free value
    free = 100
    n01 = free
    n02 = SUPPORT[0] - TRUE[0] - n01
    n21 = PREDICTED[1] - TRUE[1] - n01
    n12 = PREDICTED[2] - TRUE[2] - n02
    n10 = SUPPORT[1] - TRUE[1] - n12
    n20 = PREDICTED[0] - TRUE[0] - n10
    assert n20 + n21 + TRUE[2] == SUPPORT[2]
    row = (TRUE[0], n01, n02, n10, TRUE[1], n12, n20, n21, TRUE[2])
    names = ", ".join(f"n{a}{p} bigint" for a in range(3) for p in range(3))
    return spark.createDataFrame([row], names)


def test_published_scores(spark):
    row = metrics.scores(cells_with_marginals(spark)).first()
    for name, value in GOLDEN.items():
        assert row[name] == pytest.approx(value, abs=1e-14)


def test_published_report(spark):
    rows = {r["label"]: r for r in metrics.classification_report(cells_with_marginals(spark)).collect()}
    assert list(rows) == ["Low", "Medium (prediabetes)", "High (diabetes)", "accuracy", "macro avg", "weighted avg"]
    assert rows["Low"]["precision"] == pytest.approx(0.8956296520988404, abs=1e-14)
    assert rows["Medium (prediabetes)"]["recall"] == pytest.approx(0.0010799136069114472, abs=1e-14)
    assert rows["High (diabetes)"]["f1_score"] == pytest.approx(0.4325493376588267, abs=1e-14)
    assert rows["macro avg"]["precision"] == pytest.approx(0.43878028765297133, abs=1e-14)
    assert rows["weighted avg"]["precision"] == pytest.approx(0.8123166989167887, abs=1e-14)
    assert rows["weighted avg"]["support"] == 50736.0


def test_absent_classes_score_zero_or_do_not_count(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (2, 0)], "actual int, predicted_class int")
    row = metrics.scores(metrics.confusion_row(df, "actual")).first()
    assert row["balanced_accuracy"] == 0.5
    assert row["macro_f1"] == pytest.approx((0.8 + 0.0) / 2)
    assert metrics.confusion(df, "actual").count() == 9


@pytest.mark.parametrize("ranges", [2, 5, 16])
def test_auc_and_roc_against_pairs(spark, ranges):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        p = [rng.choice([0.1, 0.2, rng.random()]) for _ in range(3)]
        rows.append((rng.choice([0, 0, 0, 1, 2]), p))
    df = spark.createDataFrame(rows, "actual int, probabilities array<double>")
    counts = metrics.score_counts(df, "actual")
    got = {r["class_id"]: r["auc"] for r in metrics.auc(counts, ranges).collect()}
    for c in range(3):
        pos = [p[c] for a, p in rows if a == c]
        neg = [p[c] for a, p in rows if a != c]
        pairs = sum((x > y) + 0.5 * (x == y) for x in pos for y in neg)
        assert got[c] == pytest.approx(pairs / len(pos) / len(neg), abs=1e-12)
    macro = metrics.macro_auc(metrics.auc(counts, ranges)).first()[0]
    assert macro == pytest.approx(sum(got.values()) / 3)
    points = metrics.roc_points(counts, ranges).filter("class_id = 0").orderBy("fpr", "tpr").collect()
    area = sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(got[0], abs=1e-12)
    assert (points[0]["fpr"], points[0]["tpr"], points[0]["threshold"]) == (0.0, 0.0, None)
    assert (points[-1]["fpr"], points[-1]["tpr"]) == (1.0, 1.0)


def test_macro_auc_needs_every_class(spark):
    df = spark.createDataFrame([(0, [0.5, 0.2, 0.3]), (2, [0.2, 0.3, 0.5])], "actual int, probabilities array<double>")
    per_class = metrics.auc(metrics.score_counts(df, "actual").filter("class_id <> 1"))
    assert metrics.macro_auc(per_class).first()[0] is None


def test_one_hot(spark):
    df = spark.createDataFrame([(2,)], "actual int")
    assert [(r["class_id"], r["is_class"]) for r in metrics.one_hot(df, "actual").collect()] == [(0, 0), (1, 0), (2, 1)]
    assert metrics.one_hot(df, "actual").agg(F.sum("is_class")).first()[0] == 1
