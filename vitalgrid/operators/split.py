"""Exact stratified split and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgrid.codebook import TARGET
from vitalgrid.operators.ordering import smallest_by_hash


def row_digest(seed: int | str, key: str) -> Column:
    """Evenly spread order of rows that depends on seed and row identity only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def split_quotas(df: DataFrame, label: str = TARGET, test_share: float = 0.2) -> DataFrame:
    """Rows per class that go to the test part (``quota``), by largest remainder.

    ``ceil(share * n)`` rows go to the test part in total. Each class gets the
    whole part of its proportional number of training rows; rows left over go
    to the classes with the largest remainders.
    """
    counts = df.groupBy(F.col(label).alias(label)).agg(F.count(F.lit(1)).alias("n_class"))
    everything = Window.partitionBy(F.lit(0))
    wide = F.col("n_class").cast("decimal(19,0)")
    shares = (
        counts.withColumn("n", F.sum("n_class").over(everything))
        .withColumn("n_train", F.col("n") - F.ceil(F.col("n") * F.lit(test_share)))
        .withColumn("rest", F.pmod(wide * F.col("n_train").cast("decimal(19,0)"), F.col("n").cast("decimal(19,0)")))
        .withColumn(
            "whole",
            ((wide * F.col("n_train").cast("decimal(19,0)") - F.col("rest")) / F.col("n")).cast("bigint"),
        )
    )
    by_rest = Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), F.asc(label))
    left_over = F.col("n_train") - F.sum("whole").over(everything)
    extra = F.when(F.row_number().over(by_rest) <= left_over, 1).otherwise(0)
    return shares.select(label, (F.col("n_class") - F.col("whole") - extra).cast("bigint").alias("quota"))


def stratified_split(
    df: DataFrame, key: str = "rid", label: str = TARGET, test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``. Exact per class, repeatable, and no data row is shuffled."""
    quotas = split_quotas(df, label, test_share)
    return smallest_by_hash(df, quotas, row_digest(seed, key), key, group=label).withColumnRenamed(
        "chosen", "is_test"
    )


def hash_sample(df: DataFrame, size: int, key: str = "rid", seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows without replacement (all rows if there are fewer)."""
    quota = df.sparkSession.range(1).select(F.lit(size).cast("bigint").alias("quota"))
    return smallest_by_hash(df, quota, row_digest(f"{seed}:sample", key), key).filter("chosen").drop("chosen")


def class_weights(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Balanced weight ``n / (k * n_class)`` per class."""
    everything = Window.partitionBy(F.lit(0))
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class")).select(
        label,
        "n_class",
        (F.sum("n_class").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n_class"))).alias("weight"),
    )


def with_weights(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Rows with the weight of their class (one broadcast row per class)."""
    return df.join(F.broadcast(class_weights(df, label).select(label, "weight")), label)
