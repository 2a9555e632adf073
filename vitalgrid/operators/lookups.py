"""Joins of long profile rows with the definition tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid import codebook as cb
from vitalgrid.functions.decode import bmi_range, days_meaning
from vitalgrid.functions.numeric import is_whole, number_text
from vitalgrid.sources.dimensions import attribute_definitions, bmi_ranges, value_definitions


def with_definitions(long: DataFrame) -> DataFrame:
    """Attribute label, kind and domain of each row's feature (21-row broadcast)."""
    spark = long.sparkSession
    return long.join(F.broadcast(attribute_definitions(spark)), "feature")


def with_meaning(long: DataFrame) -> DataFrame:
    """Decoded ``state`` of each (feature, value); NULL when the code is unknown.

    Code meanings come by equi-join on feature and code (60-row broadcast); the
    BMI range and the counted days need no table.
    """
    spark = long.sparkSession
    values = value_definitions(spark).select("feature", "code", F.col("label").alias("_label"))
    value = F.col("value")
    code = F.when(is_whole(value) & ~F.col("feature").isin("BMI", *cb.DAY_WORDS), value.cast("int"))
    coded = long.withColumn("code", code).join(F.broadcast(values), ["feature", "code"], "left")
    state = F.when(F.col("feature") == "BMI", bmi_range(value))
    for name, word in cb.DAY_WORDS.items():
        state = state.when(F.col("feature") == name, days_meaning(value, word))
    return coded.withColumn("state", state.otherwise(F.col("_label"))).drop("_label", "code")


def with_bmi_category(df: DataFrame, bmi: Column) -> DataFrame:
    """Category id, code and label of a BMI; NULL for a negative one.

    The half-open range test is resolved to the category id first, which makes
    the lookup an equi-join with the four categories.
    """
    spark = df.sparkSession
    ranges = bmi_ranges(spark).select(
        "category_id", F.col("code").alias("category_code"), F.col("label").alias("category_label")
    )
    return df.withColumn("category_id", bmi_range(bmi, "id")).join(F.broadcast(ranges), "category_id", "left")


def with_importance(long: DataFrame, importance: DataFrame) -> DataFrame:
    """Global importance of each row's feature, NULL where there is none (21 rows)."""
    wanted = importance.select("feature", "importance_rank", "importance_mean", "importance_std")
    return long.join(F.broadcast(wanted), "feature", "left")


def with_value_text(long: DataFrame) -> DataFrame:
    return long.withColumn("value_text", number_text(F.col("value")))


def with_evaluation(df: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Evaluation figures by model name (one row per model)."""
    return df.join(F.broadcast(evaluation), "model_name", "left")
