import random

import pytest
from pyspark.sql import functions as F

from examples import profile, profiles
from vitalgrid import codebook as cb
from vitalgrid.functions.decode import bmi_range, meaning, meaning_at, slug, slug_of
from vitalgrid.functions.numeric import (
    fixed_text,
    grouped_text,
    number_text,
    percent_text,
    signed_text,
    whole_code,
)
from vitalgrid.operators import lookups
from vitalgrid.operators.contributions import to_long, undecodable
from vitalgrid.sources import dimensions as dim


def values(spark, numbers):
    return spark.createDataFrame([(float(n),) for n in numbers], "v double")


def test_definitions_cover_every_feature():
    assert len(cb.ATTRIBUTES) == 21
    assert {a[0] for a in cb.ATTRIBUTES} == set(cb.FEATURES)
    assert [a[0] for a in cb.ATTRIBUTES] == cb.FEATURES
    assert len(cb.DOMAINS) == 6 and len(cb.BMI_RANGES) == 4
    assert {f[0] for f in cb.FIELDS} == set(cb.FEATURES)
    assert {a[3] for a in cb.ATTRIBUTES} == {d[0] for d in cb.DOMAINS}


def test_dimension_sizes(spark):
    assert dim.value_definitions(spark).count() == 60
    assert dim.attribute_definitions(spark).count() == 21
    assert dim.attribute_definitions(spark, ["BMI"]).count() == 1
    assert dim.field_definitions(spark).count() == 21
    assert dim.class_labels(spark).count() == 3


@pytest.mark.parametrize(
    "bmi,label",
    [
        (18.49, "Underweight"), (18.5, "Healthy range"), (24.99, "Healthy range"), (25.0, "Overweight"),
        (29.99, "Overweight"), (30.0, "Obesity"), (0.0, "Underweight"), (-0.1, None),
    ],
)
def test_bmi_boundaries(spark, bmi, label):
    assert values(spark, [bmi]).select(bmi_range(F.col("v"))).first()[0] == label


def test_bmi_category_join(spark):
    df = lookups.with_bmi_category(values(spark, [-1, 10, 20, 27, 40]), F.col("v"))
    got = {r["v"]: (r["category_id"], r["category_code"], r["category_label"]) for r in df.collect()}
    assert got[-1.0] == (None, None, None)
    assert got[20.0] == ("BMI:Healthy range", "healthy", "Healthy range")
    assert got[40.0] == ("BMI:Obesity", "obesity", "Obesity")


def test_every_code_decodes(spark):
    rows = [(f, float(c), label) for f, codes in cb.MEANINGS.items() for c, label in codes.items()]
    df = spark.createDataFrame(rows, "feature string, value double, wanted string")
    for feature in cb.MEANINGS:
        part = df.filter(F.col("feature") == feature)
        index = F.lit(cb.FEATURES.index(feature))
        both = part.select(
            "wanted", meaning(feature, F.col("value")).alias("a"), meaning_at(index, F.col("value")).alias("b")
        )
        assert all(r["a"] == r["wanted"] == r["b"] for r in both.collect())
    joined = lookups.with_meaning(df)
    assert joined.filter("state <> wanted OR state IS NULL").count() == 0


def test_days_and_unknown_codes(spark):
    df = values(spark, [0, 1, 12, 2.5])
    text = [r[0] for r in df.select(meaning("MentHlth", F.col("v"))).collect()]
    assert text == [
        "0 mentally unhealthy days in past 30 days",
        "1 mentally unhealthy day in past 30 days",
        "12 mentally unhealthy days in past 30 days",
        None,
    ]
    assert df.select(meaning("PhysHlth", F.col("v"))).collect()[2][0] == "12 physically unhealthy days in past 30 days"
    assert [r[0] for r in df.select(meaning("Sex", F.col("v"))).collect()] == ["Female", "Male", None, None]
    assert [r[0] for r in df.select(whole_code(F.col("v"))).collect()] == [0, 1, 12, None]


def test_undecodable_profile_names_the_feature(spark):
    bad = profile()
    bad.update(Age=2.5, Income=9.0)
    got = profiles(spark, [profile(), bad]).orderBy("rid").select(undecodable()).collect()
    assert [list(r[0]) for r in got] == [[], ["Age", "Income"]]


def test_joined_and_inline_decoding_agree(spark):
    rows = [profile(b) for b in (14.5, 22.0, 27.25, 33.0)]
    wide = profiles(spark, rows).withColumn("shap", F.array(*[F.lit(0.0)] * 21))
    joined = lookups.with_meaning(to_long(wide, ["rid"]))
    inline = joined.withColumn("other", meaning_at(F.col("idx"), F.col("value")))
    assert inline.count() == 84
    assert inline.filter("NOT state <=> other").count() == 0


NUMBERS = [0.0, 40.0, 27.5, 13.25, 99.9999, 27.12345, 18.49, 123456.7, 99999.95, 0.5, 0.015625, 1234.5678, -3.25, 100.0]


def test_number_text_matches_python(spark):
    got = values(spark, NUMBERS).select("v", number_text(F.col("v")).alias("t")).collect()
    for row in got:
        want = str(int(row["v"])) if row["v"].is_integer() else f"{row['v']:g}"
        assert row["t"] == want


def test_decimal_texts_match_python(spark):
    shares = [0.0, 0.0625, 0.00125, 0.9995, 0.30468750, 1 / 3, 0.56686841]
    df = values(spark, shares + [-0.0625, -0.1, -0.0001])
    rows = df.select(
        "v",
        percent_text(F.col("v")).alias("p"),
        signed_text(F.col("v"), 3).alias("s"),
        fixed_text(F.col("v"), 2).alias("f"),
    ).collect()
    for r in rows:
        assert r["p"] == f"{r['v']:.1%}"
        assert r["s"] == f"{r['v']:+.3f}"
        assert r["f"] == f"{r['v']:.2f}"
    assert values(spark, [253680]).select(grouped_text(F.col("v"))).first()[0] == "253,680"


def test_slugs(spark):
    names = [*cb.FEATURES, "Heart Disease/Attack!", "--a--b--", "A  b"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", slug(F.col("n")).alias("s"))
    got = {r["n"]: r["s"] for r in df.collect()}
    assert all(got[n] == slug_of(n) for n in names)
    assert got["HeartDiseaseorAttack"] == "heartdiseaseorattack"
    assert got["Heart Disease/Attack!"] == "heart-disease-attack"
    assert got["A  b"] == "a--b" and got["--a--b--"] == "a--b"


def test_fixed_texts_equal_python(spark):
    """Random values, values next to and on a tie, half units, and numbers with more digits than their shortest form."""
    rng = random.Random(1)
    values = [rng.uniform(-1, 1) for _ in range(60_000)] + [rng.uniform(0, 1e6) for _ in range(40_000)]
    values += [(2 * rng.randrange(1000) + 1) / 2000 for _ in range(500)] + [k / 1024 for k in range(-500, 500)]
    values += [s * 5 * 10.0**-k for k in range(1, 8) for s in (1, -1)] + [0.0, -0.0, 2.5e-7, 1e15 + 0.25, 4503599627370497.5, -(2.0**60), 1e15 + 0.875]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for d in (0, 1, 2, 3, 4):
        got = [r[0] for r in df.select(fixed_text(F.col("v"), d)).collect()]
        assert [(v, g) for v, g in zip(values, got) if g != f"{v:.{d}f}"] == []
