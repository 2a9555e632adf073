"""Counts over labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgrid.codebook import LABELS, TARGET
from vitalgrid.functions.risk import class_label


def class_counts(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Rows per class, ascending."""
    return (
        df.groupBy(F.col(label).cast("int").alias("class_id"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy("class_id")
    )


def class_summary(df: DataFrame, label: str = TARGET, labels: dict[int, str] = LABELS) -> DataFrame:
    """Count and percentage per class. The window runs over one row per class."""
    everything = Window.partitionBy(F.lit(0))
    return (
        class_counts(df, label)
        .select(
            "class_id",
            class_label(F.col("class_id"), labels).alias("label"),
            "n_rows",
            (F.col("n_rows") * 100.0 / F.sum("n_rows").over(everything)).alias("percentage"),
        )
        .orderBy("class_id")
    )


def unknown_labels(df: DataFrame, label: str, known: DataFrame) -> DataFrame:
    """Distinct labels that are not among the known ones; empty when all are."""
    seen = df.select(F.col(label).cast("int").alias("class_id")).distinct()
    return seen.join(F.broadcast(known.select("class_id")), "class_id", "left_anti")


def value_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows per (feature, value) in one pass; combines before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.feature", "p.value").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def counts_where(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Total rows and one conditional count per name, in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(condition).alias(name) for name, condition in conditions.items()],
    )
