"""Evaluation of three-class predictions.

Every score derives from one aggregate: a single row of nine cell counts. The
curve-based scores start from counts per (class, score), so repeated scores
combine before anything is ordered.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgrid.codebook import LABELS
from vitalgrid.functions.risk import total
from vitalgrid.operators.ordering import BUCKET, running_totals

CLASSES = (0, 1, 2)


def cell(actual: int, predicted: int) -> str:
    return f"n{actual}{predicted}"


def cell_counts(actual: Column, predicted: Column) -> list[Column]:
    """The nine conditional counts, usable in any ``agg``."""
    return [
        F.count_if((actual == a) & (predicted == p)).alias(cell(a, p)) for a in CLASSES for p in CLASSES
    ]


def confusion_row(df: DataFrame, actual: str, predicted: str = "predicted_class") -> DataFrame:
    return df.agg(*cell_counts(F.col(actual), F.col(predicted)))


def confusion(df: DataFrame, actual: str, predicted: str = "predicted_class") -> DataFrame:
    """All nine cells as rows, zeros included."""
    cells = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(cell(a, p)).alias("n_rows"))
        for a in CLASSES
        for p in CLASSES
    ]
    return confusion_row(df, actual, predicted).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def support(c: int) -> Column:
    return total([F.col(cell(c, p)) for p in CLASSES])


def predicted_total(c: int) -> Column:
    return total([F.col(cell(a, c)) for a in CLASSES])


def precision(c: int) -> Column:
    return _ratio(F.col(cell(c, c)), predicted_total(c))


def recall(c: int) -> Column:
    return _ratio(F.col(cell(c, c)), support(c))


def f1(c: int) -> Column:
    """Harmonic mean as 2*tp / (actual + predicted)."""
    return _ratio(2 * F.col(cell(c, c)), support(c) + predicted_total(c))


def n_all() -> Column:
    return total([support(c) for c in CLASSES])


def accuracy() -> Column:
    return _ratio(total([F.col(cell(c, c)) for c in CLASSES]), n_all())


def _mean_present(score, present) -> Column:
    used = total([F.when(present(c), score(c)).otherwise(0.0) for c in CLASSES])
    return _ratio(used, total([F.when(present(c), 1).otherwise(0) for c in CLASSES]))


def balanced_accuracy() -> Column:
    """Mean recall over the classes present among the actual labels."""
    return _mean_present(recall, lambda c: support(c) > 0)


def macro_f1() -> Column:
    """Mean F1 over the classes present among actual or predicted labels."""
    return _mean_present(f1, lambda c: support(c) + predicted_total(c) > 0)


def weighted(score) -> Column:
    return _ratio(total([score(c) * support(c) for c in CLASSES]), n_all())


def weighted_f1() -> Column:
    return weighted(f1)


def scores(cells: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Headline scores of each row of cell counts."""
    return cells.select(
        *(keep or []),
        n_all().alias("n_rows"),
        accuracy().alias("accuracy"),
        balanced_accuracy().alias("balanced_accuracy"),
        macro_f1().alias("macro_f1"),
        weighted_f1().alias("weighted_f1"),
    )


def report_rows(labels: dict[int, str] = LABELS) -> Column:
    """Classification report as an array: one entry per class, then three summaries."""

    def entry(label: str, p: Column, r: Column, f: Column, n: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            p.alias("precision"),
            r.alias("recall"),
            f.alias("f1_score"),
            n.cast("double").alias("support"),
        )

    k = len(CLASSES)
    per_class = [entry(labels[c], precision(c), recall(c), f1(c), support(c)) for c in CLASSES]
    means = [total([s(c) for c in CLASSES]) / k for s in (precision, recall, f1)]
    return F.array(
        *per_class,
        entry("accuracy", accuracy(), accuracy(), accuracy(), accuracy()),
        entry("macro avg", *means, n_all()),
        entry("weighted avg", weighted(precision), weighted(recall), weighted(f1), n_all()),
    )


def classification_report(cells: DataFrame) -> DataFrame:
    return cells.select(F.explode(report_rows()).alias("r")).select("r.*")


def metrics_document(cells: DataFrame, area: Column, n_train: Column, n_test: Column) -> DataFrame:
    """The metrics document of one evaluation as one row, laid out like the stored file.

    ``cells`` is a ``confusion_row`` of the test rows; ``area`` the macro area
    under the curves; both counts are those of the split.
    """
    rows = report_rows()

    def figures(i: int) -> Column:
        r = F.get(rows, F.lit(i))
        return F.struct(
            r["precision"].alias("precision"), r["recall"].alias("recall"), r["f1_score"].alias("f1-score"), r["support"].alias("support")
        )

    names = [*LABELS.values()]
    report = F.struct(
        *[figures(i).alias(name) for i, name in enumerate(names)],
        accuracy().alias("accuracy"), figures(len(names) + 1).alias("macro avg"), figures(len(names) + 2).alias("weighted avg"),
    )
    counts = F.create_map(*[x for c in CLASSES for x in (F.lit(str(c)), support(c).cast("bigint"))])
    return cells.select(
        (n_train + n_test).alias("n_rows"), n_train.alias("n_train"), n_test.alias("n_test"), counts.alias("class_counts"),
        accuracy().alias("accuracy"), balanced_accuracy().alias("balanced_accuracy"), macro_f1().alias("macro_f1"),
        weighted_f1().alias("weighted_f1"), area.alias("macro_ovr_roc_auc"), report.alias("classification_report"),
    )


# --- curves -------------------------------------------------------------------


def one_hot(df: DataFrame, label: str) -> DataFrame:
    """One row per respondent and class with ``is_class`` 0/1."""
    return df.select(
        "*", F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("class_id")
    ).withColumn("is_class", (F.col(label) == F.col("class_id")).cast("int"))


def score_counts(df: DataFrame, actual: str, probabilities: str = "probabilities") -> DataFrame:
    """Positives and negatives per (class, score), one row per distinct score."""
    slim = one_hot(df.select(actual, probabilities), actual)
    return slim.groupBy("class_id", F.element_at(probabilities, F.col("class_id") + 1).alias("score")).agg(
        F.sum("is_class").alias("n_pos"), F.sum(1 - F.col("is_class")).alias("n_neg")
    )


def _bucketed_scores(counts: DataFrame, ranges: int) -> DataFrame:
    """Cut the scores of each class into ranges of about equal row numbers, high first.

    A score's range is found in two steps, among every ``step``-th bound and then
    among the bounds between two of these.
    """
    steps = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = counts.groupBy("class_id").agg(F.percentile_approx("score", steps, 10000).alias("_bounds"))
    step = isqrt(ranges)
    bounds = bounds.withColumn("_coarse", F.filter("_bounds", lambda _, i: i % step == 0))
    placed = counts.join(F.broadcast(bounds), "class_id")
    coarse = F.size(F.filter("_coarse", lambda b: b < F.col("score")))
    first = F.greatest(coarse - 1, F.lit(0)) * step
    below = first + F.size(F.filter(F.slice("_bounds", first + 1, F.lit(step)), lambda b: b < F.col("score")))
    return placed.withColumn(BUCKET, F.size("_bounds") - below).drop("_bounds", "_coarse")


def cumulative_counts(counts: DataFrame, ranges: int | None = None) -> DataFrame:
    """Positives and negatives at or above each score, per class.

    ``ranges`` cuts per class; the three-row class key alone would leave each
    class to one task. By default they follow the session's shuffle partitions.
    The scores themselves are all kept: ranges only share out the work.
    """
    if ranges is None:
        partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(16, partitions // len(CLASSES))
    return running_totals(
        _bucketed_scores(counts, ranges), [F.desc("score")], {"tp": "n_pos", "fp": "n_neg"}, ["class_id"]
    )


def class_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("class_id").agg(F.sum("n_pos").alias("p_all"), F.sum("n_neg").alias("n_all"))


def roc_points(counts: DataFrame, ranges: int | None = None) -> DataFrame:
    """One-vs-rest ROC points of each class: the origin, then one point per distinct score."""
    totals = class_totals(counts)
    points = cumulative_counts(counts, ranges).join(F.broadcast(totals), "class_id").select(
        "class_id",
        F.col("score").alias("threshold"),
        _ratio(F.col("fp"), F.col("n_all")).alias("fpr"),
        _ratio(F.col("tp"), F.col("p_all")).alias("tpr"),
    )
    origin = totals.select(
        "class_id", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def auc(counts: DataFrame, ranges: int | None = None) -> DataFrame:
    """Area under each class's curve from exact integer pair counts.

    Twice the area is the number of (positive, negative) pairs ranked right,
    ties half; sums of products need more than 64 bits on large tables.
    """
    big = "decimal(19,0)"
    totals = class_totals(counts)
    below = F.col("n_all") - F.col("fp")
    pairs = F.col("n_pos").cast(big) * (2 * below + F.col("n_neg")).cast(big)
    return (
        cumulative_counts(counts, ranges)
        .join(F.broadcast(totals), "class_id")
        .groupBy("class_id", "p_all", "n_all")
        .agg(F.sum(pairs).alias("twice"))
        .select(
            "class_id",
            "p_all",
            "n_all",
            (F.col("twice").cast("double") / (F.col("p_all").cast("double") * F.col("n_all") * 2.0)).alias("auc"),
        )
    )


def macro_auc(per_class: DataFrame) -> DataFrame:
    """Mean one-vs-rest area; NULL unless every class has both kinds of rows."""
    complete = (F.count(F.lit(1)) == len(CLASSES)) & (F.min(F.least("p_all", "n_all")) > 0)
    return per_class.agg(F.when(complete, F.avg("auc")).alias("macro_ovr_roc_auc"))
