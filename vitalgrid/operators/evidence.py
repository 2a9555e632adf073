"""Evidence packages, text summaries and the check of text drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid import codebook as cb
from vitalgrid.codebook import FEATURES
from vitalgrid.functions.decode import meaning_at, text_array
from vitalgrid.functions.guardrail import (
    has_list_markup,
    makes_prohibited_claim,
    passes,
    prohibited_claims,
    required_flags,
    stripped,
)
from vitalgrid.functions.numeric import filled, percent_text, signed_text
from vitalgrid.functions.risk import class_label, model_warning, probability_list, risk_band
from vitalgrid.functions.settle import settled
from vitalgrid.operators.contributions import attribute_list, opposing, profile_array, supporting, undecodable

KEY = "patient_number"


def is_complete(attributes: str = "attributes", probabilities: str = "probabilities") -> Column:
    """Exactly 21 attributes and three probabilities."""
    return (F.size(attributes) == len(FEATURES)) & (F.size(probabilities) == len(cb.LABELS))


def with_warning(df: DataFrame, medium_recall: Column | None = None) -> DataFrame:
    """Add the model's limitation text as ``warning``."""
    recall = F.lit(None).cast("double") if medium_recall is None else medium_recall
    return df.withColumn("warning", model_warning(recall))


def with_evidence(df: DataFrame, medium_recall: Column | None = None) -> DataFrame:
    """Add ``attributes`` and ``warning`` to scored rows with ``shap``."""
    return settled(with_warning(df, medium_recall), {"attributes": attribute_list()})


def evidence_package(df: DataFrame) -> DataFrame:
    """One nested record per respondent, ready for ``to_json``.

    Everything is in the row already, so there is no grouping.
    """
    percent = F.col("high_risk_probability") * 100
    package = F.struct(
        F.concat(F.lit("Patient #"), F.col(KEY).cast("string")).alias("local_patient_reference"),
        F.struct(
            class_label(F.col("predicted_class")).alias("label"),
            F.col("predicted_class"),
            probability_list(F.col("probabilities")).alias("probabilities"),
        ).alias("prediction"),
        F.col("attributes").alias("observations_and_shap_evidence"),
        F.struct(
            F.col("BMI").alias("bmi"), percent.alias("risk_percent"), risk_band(percent).alias("risk_band")
        ).alias("digital_twin"),
        F.col("warning").alias("model_limitation"),
        F.lit(cb.EVIDENCE_BOUNDARY).alias("evidence_boundary"),
    )
    return df.filter(is_complete()).select(KEY, package.alias("evidence"))


def incomplete_evidence(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce(is_complete(), F.lit(False)))


def evidence_json(packages: DataFrame) -> DataFrame:
    """Compact JSON of each package; NULL fields stay visible."""
    return packages.select(KEY, F.to_json("evidence", {"ignoreNullFields": "false"}).alias("evidence_json"))


def _described(entries: Column) -> Column:
    """``label (state, SHAP +0.123)`` per entry, or the words for none.

    Only the few chosen features are decoded, not all 21.
    """
    labels = F.expr(text_array([cb.ATTRIBUTE_LABEL[f] for f in FEATURES]))
    values = profile_array()
    valued = F.transform(
        entries,
        lambda e: F.struct(e["idx"].alias("idx"), e["v"].alias("v"), F.get(values, e["idx"]).alias("value")),
    )
    text = F.transform(
        valued,
        lambda e: F.concat(
            F.get(labels, e["idx"]),
            F.lit(" ("),
            meaning_at(e["idx"], e["value"]),
            F.lit(", SHAP "),
            signed_text(e["v"], 3),
            F.lit(")"),
        ),
    )
    joined = F.array_join(text, "; ")
    return F.when(F.size(entries) == 0, cb.NO_FACTORS).otherwise(joined)


def _shares() -> Column:
    """Every class with its probability."""
    return F.array_join(
        F.transform(
            probability_list(F.col("probabilities")),
            lambda p: F.concat(p["label"], F.lit(" "), percent_text(p["value"])),
        ),
        ", ",
    )


def _summary(hosted: bool, shares: Column, supports: Column, opposes: Column, gaps: Column) -> Column:
    text = filled(
        cb.SUMMARY,
        intro=F.lit(cb.INTRO_HOSTED if hosted else cb.INTRO_REPLACED),
        number=F.col(KEY).cast("string"),
        label=class_label(F.col("predicted_class")),
        shares=shares,
        supports=supports,
        opposes=opposes,
        warning=F.coalesce(F.nullif(F.col("warning"), F.lit("")), F.lit(cb.NO_WARNING)),
    )
    return F.when(gaps == 0, text)


def evidence_summary(hosted: bool = False) -> Column:
    """Summary text of a scored row with its features, ``shap`` and ``warning``.

    NULL where a feature value has no meaning in the code tables: such a row
    cannot be described (``unexplained`` lists them).
    """
    supports, opposes = _described(supporting(F.col("shap"))), _described(opposing(F.col("shap")))
    return _summary(hosted, _shares(), supports, opposes, F.size(undecodable()))


def with_summaries(df: DataFrame) -> DataFrame:
    """Add ``summary`` and ``hosted_summary``, the texts of ``evidence_summary``; what they share is worked out once per row."""
    chosen = settled(df, {"_supports": supporting(F.col("shap")), "_opposes": opposing(F.col("shap")), "_gaps": F.size(undecodable())})
    told = settled(chosen, {"_supports": _described(F.col("_supports")), "_opposes": _described(F.col("_opposes")), "_shares": _shares()})
    parts = [F.col(c) for c in ("_shares", "_supports", "_opposes", "_gaps")]
    texts = {name: _summary(hosted, *parts) for name, hosted in (("summary", False), ("hosted_summary", True))}
    return told.withColumns(texts).drop("_shares", "_supports", "_opposes", "_gaps")


def unexplained(df: DataFrame) -> DataFrame:
    """Rows whose values cannot all be decoded, with the features in question."""
    return df.withColumn("undecodable", undecodable()).filter(F.size("undecodable") > 0)


def checked_drafts(drafts: DataFrame, text: str = "draft") -> DataFrame:
    """Each wording rule as its own column beside the verdict."""
    body = F.col(text)
    flags = required_flags(body)
    return drafts.withColumns(
        {
            **flags,
            "claims": prohibited_claims(body),
            "makes_claim": makes_prohibited_claim(body),
            "has_markup": has_list_markup(body),
            "passes": passes(body),
        }
    )


def with_guidance(drafts: DataFrame, text: str = "draft") -> DataFrame:
    """Final text per draft: the draft itself, the summary, or NULL for an empty draft.

    ``drafts`` carries the columns the summary needs. ``outcome`` is ``empty``,
    ``replaced`` or ``kept``; a draft whose respondent is not there (no
    ``probabilities``) has ``no respondent`` and no text.
    """
    trimmed = drafts.withColumn("_draft", stripped(F.coalesce(F.col(text), F.lit(""))))
    outcome = (
        F.when(F.col("probabilities").isNull(), "no respondent").when(F.col("_draft") == "", "empty").when(passes(F.col("_draft")), "kept").otherwise("replaced")
    )
    final = F.when(F.col("outcome") == "kept", F.col("_draft")).when(
        F.col("outcome") == "replaced", evidence_summary()
    )
    return trimmed.withColumn("outcome", outcome).withColumn("guidance", final).drop("_draft")
