import json
import re

import pytest
from pyspark.sql import functions as F

from examples import explained, profile
from vitalgrid import codebook as cb
from vitalgrid.functions.guardrail import LIST_PATTERN
from vitalgrid.operators import evidence

SAFE = "Read this as a research note: it is non-causal, medium recall is 0.0, and it is not medical advice."
UNSAFE = "- Smoking is a strong predictor here\n- so stopping would have a protective effect"


def test_package_keeps_everything(spark):
    df = evidence.with_evidence(explained(spark), F.lit(0.001))
    package = evidence.evidence_package(df)
    body = json.loads(evidence.evidence_json(package).first()["evidence_json"])
    assert body["local_patient_reference"] == "Patient #1"
    assert len(body["observations_and_shap_evidence"]) == 21
    assert [p["value"] for p in body["prediction"]["probabilities"]] == [0.30, 0.20, 0.50]
    assert body["observations_and_shap_evidence"][0]["shap_value"] == 0.31
    assert [a["key"] for a in body["observations_and_shap_evidence"]] == cb.FEATURES
    assert "recall is 0.10%" in body["model_limitation"]
    assert body["evidence_boundary"] == cb.EVIDENCE_BOUNDARY
    assert body["digital_twin"]["risk_band"] == "Moderate"


def test_incomplete_evidence_is_set_aside(spark):
    df = evidence.with_evidence(explained(spark))
    short = df.withColumn("attributes", F.slice("attributes", 1, 20))
    two = df.withColumn("probabilities", F.slice("probabilities", 1, 2))
    for broken in (short, two):
        assert evidence.evidence_package(broken).count() == 0
        assert evidence.incomplete_evidence(broken).count() == 1
    assert evidence.incomplete_evidence(df).count() == 0


def test_summary_wording(spark):
    df = evidence.with_warning(explained(spark, probabilities=(0.2, 0.1, 0.7)), F.lit(0.0))
    text = df.select(evidence.evidence_summary()).first()[0]
    assert "Low 20.0%, Medium (prediabetes) 10.0%, High (diabetes) 70.0%" in text
    assert text.startswith("The local model draft did not pass")
    assert "High blood pressure (High blood pressure not reported, SHAP +0.310)" in text
    assert "High cholesterol (High cholesterol not reported, SHAP -0.170)." in text
    hosted = df.select(evidence.evidence_summary(hosted=True)).first()[0]
    assert hosted.startswith("This hosted deployment uses a deterministic, safety-checked evidence summary")
    flat = evidence.with_warning(explained(spark, shap=[0.0] * 21))
    assert "contributions were no factors." in flat.select(evidence.evidence_summary()).first()[0]


def drafts(spark, texts):
    rows = explained(spark, [profile()] * len(texts))
    named = spark.createDataFrame(list(enumerate(texts)), "rid bigint, draft string")
    return evidence.with_warning(rows.join(named, "rid"), F.lit(0.0))


def test_drafts_are_kept_replaced_or_empty(spark):
    texts = [SAFE, UNSAFE, "  \n\t ", None, f"  {SAFE}\n ", SAFE + " Exercise REDUCES THE RISK.", SAFE + "\n  - item"]
    got = evidence.with_guidance(drafts(spark, texts)).orderBy("rid").collect()
    assert [r["outcome"] for r in got] == ["kept", "replaced", "empty", "empty", "kept", "replaced", "replaced"]
    assert got[0]["guidance"] == SAFE and got[4]["guidance"] == SAFE
    assert got[2]["guidance"] is None
    assert "non-causal, for research only, and not medical advice" in got[1]["guidance"]


def test_summary_itself_has_no_markup_or_claims(spark):
    df = evidence.with_warning(explained(spark), F.lit(0.0)).withColumn("draft", evidence.evidence_summary())
    checked = evidence.checked_drafts(df).first()
    assert checked["has_markup"] is False and list(checked["claims"]) == []


def test_claims_are_named_in_order(spark):
    text = "It is a strong predictor. It CAUSES DIABETES and may increase the risk."
    row = evidence.checked_drafts(drafts(spark, [text])).first()
    assert list(row["claims"]) == ["causes diabetes", "increase the risk", "strong predictor"]
    assert row["passes"] is False and row["has_research"] is False


@pytest.mark.parametrize(
    "text",
    ["# h", "####### seven", "text # no", "- a", "-a", "a\n* b", "a\r* b", "12. x", "12.x", " - nb", "a\n\n \t3. x",
     "٣. arabic", "a - x", "*bold* text", "", "a\x0b- x", "a\n\x1c- x"],
)
def test_markup_pattern_matches_python(spark, text):
    want = re.search(r"(?m)^\s*(?:#{1,6}\s|[-*]\s|\d+\.\s)", text) is not None
    got = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(LIST_PATTERN)).first()[0]
    assert got is want


def test_both_summaries_share_their_parts(spark):
    df = evidence.with_warning(explained(spark), F.lit(0.0))
    both = evidence.with_summaries(df)
    want = df.select(evidence.evidence_summary(), evidence.evidence_summary(hosted=True)).collect()
    assert sorted(map(tuple, both.select("summary", "hosted_summary").collect())) == sorted(map(tuple, want))
    # one ranking for either side
    assert both._jdf.queryExecution().optimizedPlan().toString().count("array_sort") <= 2
