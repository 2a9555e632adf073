"""Column expressions over model outputs: labels, bands, signs, descriptors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalgrid import codebook as cb
from vitalgrid.functions.decode import literal_map
from vitalgrid.functions.numeric import filled, percent_text


def class_label(class_id: Column, labels: dict[int, str] = cb.LABELS) -> Column:
    """Label of a class id (truncated to an integer); NULL outside the labels."""
    return F.try_element_at(literal_map(labels), class_id.cast("int"))


def recorded_label(target: Column) -> Column:
    return F.coalesce(class_label(target), F.lit(cb.NOT_SUPPLIED))


def first_largest(probabilities: Column) -> Column:
    """Index of the largest entry; the first one wins a tie."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def probability_of(probabilities: Column, class_index: int) -> Column:
    """Probability of one class, 0.0 when the model has no such class."""
    return F.coalesce(F.try_element_at(probabilities, F.lit(class_index + 1)), F.lit(0.0))


def probability_list(probabilities: Column, labels: dict[int, str] = cb.LABELS) -> Column:
    """``array<struct<class_id, label, value>>`` in class order."""
    return F.transform(
        probabilities,
        lambda p, i: F.struct(
            i.cast("int").alias("class_id"),
            class_label(i, labels).alias("label"),
            p.alias("value"),
        ),
    )


def prediction(probabilities: Column) -> Column:
    """Prediction struct of one row."""
    winner = first_largest(probabilities)
    return F.struct(
        winner.alias("predicted_class"),
        class_label(winner).alias("label"),
        probability_of(probabilities, 2).alias("high_risk_probability"),
        probability_list(probabilities).alias("probabilities"),
    )


def sign_word(value: Column, positive: str, negative: str, zero: str) -> Column:
    return F.when(value > 0, positive).when(value < 0, negative).otherwise(zero)


def direction(shap: Column) -> Column:
    return sign_word(shap, "supports", "opposes", "neutral")


def relationship(shap: Column) -> Column:
    return sign_word(shap, "SUPPORTS_PREDICTION", "OPPOSES_PREDICTION", "NEUTRAL_FOR_PREDICTION")


def change_word(delta: Column) -> Column:
    return sign_word(delta, "up", "down", "none")


def shape_coefficient(bmi: Column) -> Column:
    return (bmi - 22.0) * 0.5


def _banded(percent: Column, part: int) -> Column:
    return (
        F.when(percent > 70, cb.HIGH_BAND[part])
        .when(percent >= 40, cb.MODERATE_BAND[part])
        .otherwise(cb.LOW_BAND[part])
    )


def risk_band(percent: Column) -> Column:
    return _banded(percent, 0)


def risk_colour(percent: Column) -> Column:
    return _banded(percent, 1)


def sex_word(sex: Column, male: str = "male", female: str = "female") -> Column:
    return F.when(sex.cast("int") == 1, male).otherwise(female)


def model_warning(medium_recall: Column) -> Column:
    """Limitation text shown with every result of the evaluated model."""
    return F.when(
        medium_recall < 0.10,
        filled(cb.LOW_RECALL_WARNING, recall=percent_text(medium_recall, 2)),
    ).otherwise(cb.GENERIC_WARNING)


def total(parts: list[Column]) -> Column:
    return reduce(lambda left, right: left + right, parts)
