"""The codebook as small dimension tables (4 to 60 rows, so always broadcast)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid import codebook as cb


def domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(cb.DOMAINS, "domain string, domain_label string")


def attributes(spark: SparkSession) -> DataFrame:
    """21 attribute definitions with their display order from 0."""
    rows = [(order, *row) for order, row in enumerate(cb.ATTRIBUTES)]
    return spark.createDataFrame(
        rows, "display_order int, feature string, label string, kind string, domain string"
    )


def attribute_definitions(spark: SparkSession, keys: list[str] | None = None) -> DataFrame:
    """Attributes with their domain label, limited to the wanted keys."""
    return attributes(spark).join(F.broadcast(domains(spark)), "domain").filter(
        F.col("feature").isin(keys or cb.FEATURES)
    )


def value_definitions(spark: SparkSession) -> DataFrame:
    """One row per (feature, code): 60 rows exploded from the code maps."""
    maps = spark.createDataFrame(
        list(cb.BINARY_MEANINGS.items()), "feature string, codes map<int,string>"
    ).unionByName(
        spark.createDataFrame(
            list(cb.ORDINAL_MEANINGS.items()), "feature string, codes map<int,string>"
        )
    )
    return maps.select("feature", F.explode("codes").alias("code", "label")).select(
        F.concat_ws(":", "feature", "code").alias("value_id"), "feature", "code", "label"
    )


def bmi_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        cb.BMI_RANGES,
        "category_id string, code string, label string, minimum double, maximum double, display_order int",
    )


def field_definitions(spark: SparkSession) -> DataFrame:
    """Form metadata: label, kind, default, limits and step of 21 fields."""
    return spark.createDataFrame(
        cb.FIELDS,
        "feature string, field_label string, field_kind string, default_value double, "
        "minimum double, maximum double, step double",
    )


def class_labels(spark: SparkSession) -> DataFrame:
    rows = [(i, cb.LABELS[i], cb.SHORT_LABELS[i]) for i in cb.LABELS]
    return spark.createDataFrame(rows, "class_id int, label string, short_label string")
