"""What-if scenarios for every respondent, twin descriptors and refresh tests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid import codebook as cb
from vitalgrid.codebook import FEATURES, SCENARIO_FEATURES
from vitalgrid.functions.risk import (
    change_word,
    prediction,
    risk_band,
    risk_colour,
    sex_word,
    shape_coefficient,
)
from vitalgrid.operators.ordering import one_per_key

Scorer = Callable[[DataFrame], DataFrame]
# Fixed value: percent points within which two risks count as equal.
SAME_RISK = 0.0001


@dataclass(frozen=True)
class Scenario:
    """A named edit: feature -> column expression over the respondent's own values."""

    name: str
    edits: dict[str, Column]

    def __post_init__(self) -> None:
        wrong = sorted(set(self.edits) - set(SCENARIO_FEATURES))
        if wrong:
            raise ValueError(f"not editable in a scenario: {', '.join(wrong)}")


def default_scenario() -> Scenario:
    """Five BMI points less (not below 12) and physically active."""
    return Scenario(
        "lower_bmi_active",
        {"BMI": F.greatest(F.lit(12.0), F.col("BMI") - 5.0), "PhysActivity": F.lit(1.0)},
    )


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str = "patient_number") -> DataFrame:
    """Rows with a table of edited values laid over them.

    Only editable features may appear; a NULL or absent value keeps the
    respondent's own. Of several rows for one respondent, the one with the
    largest values (feature by feature, in column order) counts.
    """
    edited = [c for c in overrides.columns if c != key]
    wrong = sorted(set(edited) - set(SCENARIO_FEATURES))
    if wrong:
        raise ValueError(f"not editable in a scenario: {', '.join(wrong)}")
    renamed = one_per_key(overrides, [key]).select(key, *[F.col(c).alias(f"_{c}") for c in edited])
    joined = df.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in edited}).drop(
        *[f"_{c}" for c in edited]
    )


def changed_values(before: str = "base.", after: str = "") -> Column:
    """``array<struct<feature, from, to>>`` of differing features in feature order.

    The prefixes name the two states of a row, such as ``base.`` for a struct.
    """
    changes = ", ".join(
        f"IF({before}{f} <> {after}{f}, named_struct('feature', '{f}', 'from', {before}{f}, 'to', {after}{f}), NULL)"
        for f in FEATURES
    )
    return F.expr(f"array_compact(array({changes}))")


def simulate(df: DataFrame, scenarios: list[Scenario], score: Scorer) -> DataFrame:
    """Every respondent under every scenario, beside the respondent's own score.

    Scenarios multiply the rows in place (``explode``), and both scores are
    taken on the same row, so nothing is joined or shuffled. The result carries
    the scenario's values in the feature columns and the own ones in ``base``.
    """
    names = F.array(*[F.lit(s.name) for s in scenarios])
    scored = score(df)
    kept = [c for c in df.columns if c not in FEATURES]
    own = scored.select(
        *kept,
        F.struct(*FEATURES).alias("base"),
        F.struct("probabilities", "predicted_class", "predicted_label", "high_risk_probability").alias("baseline"),
        *FEATURES,
        F.explode(names).alias("scenario_id"),
    )
    values = {}
    for f in FEATURES:
        expr = F.col(f)
        for s in scenarios:
            if f in s.edits:
                expr = F.when(F.col("scenario_id") == s.name, s.edits[f]).otherwise(expr)
        values[f] = expr
    edited = own.select(*kept, "base", "baseline", "scenario_id", *[values[f].alias(f) for f in FEATURES])
    result = score(edited)
    delta = F.col("high_risk_probability") - F.col("baseline.high_risk_probability")
    return result.withColumns(
        {
            "changes": changed_values(),
            "high_risk_change": delta,
            "change_points": delta * 100,
            "change_direction": change_word(delta),
        }
    )


def twin_columns(bmi: Column, sex: Column, high_risk: Column) -> list[Column]:
    """Flat descriptor columns of one scored row."""
    percent = high_risk * 100
    return [
        bmi.alias("bmi"),
        sex_word(sex).alias("gender"),
        shape_coefficient(bmi).alias("beta0"),
        percent.alias("risk_percent"),
        risk_band(percent).alias("risk_band"),
        risk_colour(percent).alias("risk_colour"),
    ]


def twins(scored: DataFrame, keep: list[str]) -> DataFrame:
    return scored.select(*keep, *twin_columns(F.col("BMI"), F.col("Sex"), F.col("high_risk_probability")))


def case_twin(number: Column, bmi: Column, sex: Column, high_risk: Column) -> Column:
    """Descriptor struct with the field names of the case record."""
    percent = high_risk * 100
    return F.struct(
        number.alias("dataset_patient_number"),
        bmi.alias("bmi"),
        sex_word(sex).alias("gender"),
        shape_coefficient(bmi).alias("smpl_beta_0"),
        percent.alias("risk_percent"),
        risk_band(percent).alias("risk_band"),
        risk_colour(percent).alias("risk_colour"),
    )


def case_records(simulated: DataFrame, number: str = "patient_number") -> DataFrame:
    """Case-study record per respondent and scenario: both states, edits, limitation."""
    n = F.col(number)
    edits = F.transform(
        "changes",
        lambda c: F.struct(c["feature"].alias("feature"), c["from"].alias("current"), c["to"].alias("scenario")),
    )
    return simulated.select(
        n.alias(number),
        "scenario_id",
        case_twin(n, F.col("base.BMI"), F.col("base.Sex"), F.col("baseline.high_risk_probability")).alias("current"),
        case_twin(n, F.col("BMI"), F.col("Sex"), F.col("high_risk_probability")).alias("scenario"),
        edits.alias("edited_features"),
        F.lit(cb.CASE_LIMITATION).alias("important_limitation"),
    )


def prediction_pair(simulated: DataFrame, keep: list[str]) -> DataFrame:
    """Baseline and scenario prediction structs with the changes between them."""
    return simulated.select(
        *keep,
        prediction(F.col("baseline.probabilities")).alias("baseline"),
        prediction(F.col("probabilities")).alias("scenario"),
        "changes",
        "high_risk_change",
    )


def _same_twin(new: str, old: str, with_gender: bool) -> Column:
    same = (F.col(f"{new}.bmi") == F.col(f"{old}.bmi")) & (
        F.abs(F.col(f"{new}.risk_percent") - F.col(f"{old}.risk_percent")) < SAME_RISK
    )
    return same & (F.col(f"{new}.gender") == F.col(f"{old}.gender")) if with_gender else same


def needs_refresh(new: DataFrame, old: DataFrame, key: str = "patient_number", with_gender: bool = True) -> DataFrame:
    """Descriptors that are new or differ from the stored ones.

    One equi-join on the respondent; stored snapshots bucketed on the key join
    without moving.
    """
    on = (F.col(f"new.{key}") == F.col(f"old.{key}")) & _same_twin("new", "old", with_gender)
    return new.alias("new").join(old.alias("old"), on, "left_anti")


def up_to_date(new: DataFrame, old: DataFrame, key: str = "patient_number", with_gender: bool = True) -> DataFrame:
    on = (F.col(f"new.{key}") == F.col(f"old.{key}")) & _same_twin("new", "old", with_gender)
    return new.alias("new").join(old.alias("old"), on, "left_semi")
