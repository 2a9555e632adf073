import json

import pytest
from pyspark.sql import functions as F

from examples import profile, profiles
from vitalgrid.codebook import FEATURES, TARGET
from vitalgrid.operators import clean, scenario
from vitalgrid.plans.derived import demo_score, raw_survey, survey
from vitalgrid.sources import artifacts, survey as source


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_column_checks_report_sorted_names(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "BMI double, Zeta double")
    missing = source.missing_columns(df)
    assert missing == sorted(missing) and "BMI" not in missing and len(missing) == 20
    assert TARGET in source.missing_columns(df, with_target=True)
    assert source.extra_columns(df) == ["Zeta"]
    with pytest.raises(source.MissingColumns, match="Age"):
        clean.import_clean(df)


def test_profile_file_with_target_is_refused(spark):
    df = profiles(spark, [profile()]).drop("rid", "patient_number").withColumn(TARGET, F.lit(0.0))
    with pytest.raises(source.MissingColumns, match=TARGET):
        source.require_exact_columns(df)
    source.require_exact_columns(df.drop(TARGET))


def test_csv_folder_any_case_any_column_order(spark, tmp_path):
    values = profile()
    shuffled = [*reversed(FEATURES)]
    header = ",".join(["rid", *shuffled])
    line = ",".join(["0", *[str(values[f]) for f in shuffled]])
    write(tmp_path / "in" / "one.csv", f"{header}\n{line}\n")
    write(tmp_path / "in" / "two.CSV", f"{header}\n{line.replace('33.5', 'n/a')}\n")
    write(tmp_path / "in" / "notes.txt", "nothing")
    df = source.read_csv(spark, str(tmp_path / "in"), source_names=True)
    assert all(df.schema[f].dataType.simpleString() == "string" for f in FEATURES)
    assert {r["source_name"] for r in df.collect()} == {"one.csv", "two.CSV"}
    cleaned = clean.import_clean(df)
    assert cleaned.valid.count() == 1 and cleaned.dropped.count() == 1
    row = cleaned.valid.first()
    assert {f: row[f] for f in FEATURES} == values


def test_metrics_document_round_trip(spark, tmp_path):
    per_class = {"precision": 0.5, "recall": 0.25, "f1-score": 0.3, "support": 4.0}
    body = {
        "n_rows": 10, "n_train": 8, "n_test": 2, "class_counts": {"0": 9, "1": 1}, "accuracy": 0.9,
        "balanced_accuracy": 0.5, "macro_f1": 0.4, "weighted_f1": 0.8, "macro_ovr_roc_auc": 0.7,
        "classification_report": {
            "Low": per_class, "Medium (prediabetes)": {**per_class, "recall": 0.01}, "High (diabetes)": per_class,
            "accuracy": 0.9, "macro avg": per_class, "weighted avg": per_class,
        },
    }
    path = write(tmp_path / "metrics.json", json.dumps(body, indent=2))
    row = artifacts.evaluation_row(artifacts.read_metrics(spark, path), "m").first()
    assert (row["accuracy"], row["medium_recall"], row["macro_roc_auc"]) == (0.9, 0.01, 0.7)
    assert artifacts.read_metrics(spark, str(tmp_path / "absent.json")).count() == 0
    assert artifacts.read_metrics(spark, write(tmp_path / "bad.json", "{not json")).count() == 0


def test_importance_file_and_rank(spark, tmp_path):
    path = write(
        tmp_path / "imp.csv",
        "feature,importance_mean,importance_std\nBMI,0.04,0.01\nAge,0.02,0.004\nSex,0.02,0.004\n",
    )
    rows = artifacts.read_importance(spark, path).orderBy("importance_rank").collect()
    assert [(r["feature"], r["importance_rank"]) for r in rows] == [("BMI", 1), ("Sex", 2), ("Age", 3)]
    assert artifacts.read_importance(spark, str(tmp_path / "none.csv")).count() == 0


def test_writers(spark, tmp_path, tiny):
    scored = demo_score(survey(spark, tiny)).withColumn("patient_number", F.col("rid") + 1)
    twins = scenario.twins(scored, ["patient_number"])
    artifacts.write_twins(twins, str(tmp_path / "twins"))
    back = spark.read.json(str(tmp_path / "twins"))
    assert back.count() == twins.count()
    assert {r[0] for r in back.select("risk_band").distinct().collect()} <= {"Low", "Moderate", "High"}
    artifacts.write_csv(twins, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == twins.count()
    one = twins.limit(1).withColumn("nothing", F.lit(None).cast("string"))
    artifacts.write_json_documents(one, str(tmp_path / "json"))
    document = json.loads(spark.read.text(str(tmp_path / "json")).first()[0])
    assert document["nothing"] is None and document["bmi"] > 0
    artifacts.write_table(twins, str(tmp_path / "table"), ["risk_band"])
    assert spark.read.parquet(str(tmp_path / "table")).count() == twins.count()


def test_parquet_scan_reads_only_what_is_asked(spark, tiny):
    plan = survey(spark, tiny).select("BMI")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
    assert raw_survey(spark, tiny).count() == 1500


def test_documents_are_stored_compressed_and_read_back(spark, tmp_path):
    path = str(tmp_path / "documents")
    artifacts.write_json_documents(spark.range(3).selectExpr("id", "repeat('x', 100) AS t"), path, compression="gzip")
    assert len(list((tmp_path / "documents").glob("*.gz"))) > 0 and not list((tmp_path / "documents").glob("*.txt"))
    assert spark.read.text(path).count() == 3


def test_row_ids_move_no_row(spark, tmp_path):
    """Files of several blocks: places follow the text, and only the one row per block is ordered and exchanged."""
    for name, n in (("b.csv", 700), ("a.csv", 300)):
        (tmp_path / name).write_text("x\n" + "".join(f"{name}-{k}\n" for k in range(n)))
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        df = source.read_csv(spark, str(tmp_path), row_ids=True)
        got = sorted((r["rid"], r["source_row"], r["x"]) for r in df.collect())
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    want = [("a.csv", k) for k in range(300)] + [("b.csv", k) for k in range(700)]
    assert got == [(i + 1, k + 1, f"{name}-{k}") for i, (name, k) in enumerate(want)]
    assert "row_number" not in plan
