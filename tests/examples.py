"""Small profiles and outputs the tests share."""

from pyspark.sql import functions as F

from vitalgrid.codebook import FEATURES

# a clear supporter, a clear opponent, a zero, and ties
SHAP = [0.31, -0.17, 0.0] + [0.02] * (len(FEATURES) - 3)


def profile(bmi=33.5):
    values = {f: 0.0 for f in FEATURES}
    values.update(BMI=bmi, Age=9.0, GenHlth=2.0, Education=4.0, Income=3.0, MentHlth=5.0)
    return values


def profiles(spark, rows):
    """Rows of feature dicts as the wide table, numbered from 1."""
    data = [(i, *[float(r[f]) for f in FEATURES]) for i, r in enumerate(rows)]
    schema = "rid bigint, " + ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(data, schema).withColumn("patient_number", F.col("rid") + 1)


def explained(spark, rows=None, probabilities=(0.30, 0.20, 0.50), shap=None):
    """Profiles with a fixed prediction and fixed contributions."""
    df = profiles(spark, rows or [profile()])
    return df.withColumns(
        {
            "probabilities": F.array(*[F.lit(p) for p in probabilities]),
            "predicted_class": F.lit(2),
            "high_risk_probability": F.lit(probabilities[2]),
            "shap": F.array(*[F.lit(float(v)) for v in (shap or SHAP)]),
        }
    )
