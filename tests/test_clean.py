import pytest
from pyspark.sql import functions as F

from examples import profile
from vitalgrid.codebook import FEATURES, TARGET
from vitalgrid.operators import clean


def raw(spark, rows):
    """Rows of text values; each row overrides the example profile."""
    data = []
    for i, change in enumerate(rows):
        values = {f: str(v) for f, v in profile().items()} | {TARGET: "0.0"} | change
        data.append((i, *[values[f] for f in [*FEATURES, TARGET]]))
    return spark.createDataFrame(data, "rid bigint, " + ", ".join(f"{f} string" for f in [*FEATURES, TARGET]))


def ids(df):
    return sorted(r["rid"] for r in df.collect())


TEXTS = [("40.0", 40.0), (" 1e1 ", 10.0), ("+5.", 5.0), (".5", 0.5), ("1f", None), ("1d", None), ("NaN", None),
         ("inf", None), ("", None), ("n/a", None), ("0x1p3", None), ("1e999", None), ("12 3", None)]


def test_number_guard(spark):
    df = spark.createDataFrame([(t,) for t, _ in TEXTS], "BMI string")
    got = [r[0] for r in clean.coerced(df, ["BMI"]).collect()]
    assert got == [v for _, v in TEXTS]
    floats = spark.createDataFrame([(float("nan"),), (float("inf"),), (3.0,)], "BMI double")
    assert [r[0] for r in clean.coerced(floats, ["BMI"]).collect()] == [None, None, 3.0]


def test_training_policy_truncates_then_filters_labels(spark):
    df = raw(spark, [{}, {TARGET: "1.5"}, {TARGET: "3.0"}, {TARGET: "-0.5"}, {TARGET: None}, {"BMI": "x"}])
    rows = {r["rid"]: r[TARGET] for r in clean.training_clean(df).valid.collect()}
    assert rows == {0: 0, 1: 1, 3: 0}
    assert clean.training_clean(df).quarantine.count() == 0


def test_strict_policy_fails_on_other_labels(spark):
    df = raw(spark, [{}, {TARGET: "1.7"}, {TARGET: "3.0"}, {"BMI": ""}, {"BMI": "1f"}, {"Age": None}])
    cleaned = clean.strict_load(df)
    assert ids(cleaned.valid) == [0, 1] and ids(cleaned.dropped) == [3, 5] and ids(cleaned.quarantine) == [2, 4]
    with pytest.raises(ValueError, match="BMI:not a number: 1 rows; Diabetes_012:label: 1 rows"):
        cleaned.require_valid()
    numeric = clean.training_clean(raw(spark, [{}])).valid.withColumn(TARGET, F.lit(2.0))
    assert clean.strict_load(numeric).require_valid().first()[TARGET] == 2


def test_import_policy_rules(spark):
    df = raw(
        spark,
        [{}, {TARGET: None}, {TARGET: "1.5"}, {"HighBP": "2"}, {"BMI": "11.9"}, {"BMI": "100"}, {"Age": "13.5"},
         {"Age": "2.5"}, {"Income": ""}, {TARGET: "junk"}, {"GenHlth": "0", "Sex": "0.5"}],
    )
    cleaned = clean.import_clean(df)
    assert ids(cleaned.valid) == [0, 1, 5, 7, 9]
    assert ids(cleaned.dropped) == [8]
    broken = {r["rid"]: list(r["violations"]) for r in cleaned.quarantine.collect()}
    assert broken == {
        2: ["Diabetes_012:label"], 3: ["HighBP:binary"], 4: ["BMI:below"], 6: ["Age:above"],
        10: ["GenHlth:below", "Sex:binary"],
    }
    counts = {r["rule"]: r["n_rows"] for r in clean.rule_counts(cleaned, clean.import_rules()).collect()}
    assert len(counts) == 28 and counts["BMI:below"] == 1 and counts["Sex:binary"] == 1 and counts["BMI:above"] == 0


def test_import_without_target_and_guards(spark):
    df = raw(spark, [{}, {}, {"BMI": ""}]).drop(TARGET)
    assert TARGET not in clean.import_clean(df).valid.columns
    assert clean.import_clean(df, max_rows=2).valid.count() == 2
    with pytest.raises(ValueError, match="more than 1"):
        clean.import_clean(df, max_rows=1)
    with pytest.raises(ValueError, match="no complete rows"):
        clean.require_rows(clean.import_clean(raw(spark, [{"BMI": ""}])))


def test_single_profiles(spark):
    df = raw(spark, [{}, {}, {}, {"BMI": "?"}]).drop(TARGET)
    named = df.withColumn("source_name", F.element_at(F.array(*[F.lit(x) for x in "aabc"]), (F.col("rid") + 1).cast("int")))
    got = {r["source_name"]: (r["verdict"], r["BMI"]) for r in clean.single_profiles(named).collect()}
    assert got == {"a": ("not exactly one row", None), "b": ("ok", 33.5), "c": ("missing values", None)}
