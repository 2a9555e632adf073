"""Rows that must not slip through: odd files, odd values, repeated keys, missing partners."""

from pyspark.sql import functions as F

from examples import SHAP, explained, profile, profiles
from vitalgrid.codebook import FEATURES, TARGET
from vitalgrid.operators import catalog, clean, evidence, graph, numbering, scenario
from vitalgrid.operators.ordering import one_per_key
from vitalgrid.sources import survey

import pytest


def write(folder, name, columns, rows):
    lines = [",".join(columns)] + [",".join(str(r[c]) for c in columns) for r in rows]
    (folder / name).write_text("\n".join(lines) + "\n")


def uploads(folder):
    rows = [profile(20.0 + i) for i in range(7)]
    write(folder, "a.csv", FEATURES, rows[:3])
    write(folder, "b.csv", FEATURES[::-1], rows[3:])


def test_columns_of_each_file_follow_its_own_header(spark, tmp_path):
    uploads(tmp_path)
    got = survey.read_uploads(spark, str(tmp_path), row_ids=True).orderBy("rid").collect()
    assert [r["BMI"] for r in got] == [str(20.0 + i) for i in range(7)]
    assert [(r["source_name"], r["rid"], r["source_row"]) for r in got] == [
        ("a.csv", 1, 1), ("a.csv", 2, 2), ("a.csv", 3, 3), ("b.csv", 4, 1), ("b.csv", 5, 2), ("b.csv", 6, 3), ("b.csv", 7, 4)
    ]
    assert all(float(r["Age"]) == 9.0 and float(r["Income"]) == 3.0 for r in got)


def test_a_header_that_differs_is_an_error_not_a_swap(spark, tmp_path):
    uploads(tmp_path)
    with pytest.raises(Exception, match="(?i)header"):
        survey.read_csv(spark, str(tmp_path)).select(*FEATURES).collect()


def test_file_order_survives_splits(spark, tmp_path):
    write(tmp_path, "long.csv", [*FEATURES, TARGET], [{**profile(12.0 + i % 80), TARGET: 0.0} for i in range(3000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        df = survey.read_csv(spark, str(tmp_path), row_ids=True)
        got = df.orderBy("rid").select("rid", "source_row", "BMI").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["rid"] for r in got] == [r["source_row"] for r in got] == list(range(1, 3001))
    assert [float(r["BMI"]) for r in got] == [12.0 + i % 80 for i in range(3000)]


def test_infinite_values_break_their_rule(spark):
    rows = [{**profile(), "BMI": b} for b in ("inf", "-Infinity", "1e999", "30", "nan")]
    df = spark.createDataFrame([(i, *[str(r[f]) for f in FEATURES]) for i, r in enumerate(rows)], ["rid", *FEATURES])
    got = {r["rid"]: (r["dropped"], list(r["violations"])) for r in clean.import_clean(df).tagged.collect()}
    assert got == {0: (False, ["BMI:above"]), 1: (False, ["BMI:below"]), 2: (False, ["BMI:above"]), 3: (False, []), 4: (True, [])}
    numeric = profiles(spark, [profile()]).withColumn("BMI", F.lit(float("inf")))
    assert clean.import_clean(numeric).quarantine.count() == 1


def test_row_guard_counts_complete_rows(spark):
    df = profiles(spark, [profile()] * 3)
    assert clean.import_clean(df, max_rows=3).valid.count() == 3
    with pytest.raises(ValueError):
        clean.import_clean(df, max_rows=2)


def test_undecodable_profiles_get_no_graph_and_no_summary(spark):
    df = explained(spark, [profile(), {**profile(), "Age": 2.5}])
    nodes, edges = graph.nodes(df, "forest"), graph.edges(df)
    assert {r[0] for r in nodes.select("patient_number").distinct().collect()} == {1} and nodes.count() == 98
    assert edges.count() == 135 and nodes.filter("label IS NULL").isEmpty()
    texts = evidence.with_warning(df, F.lit(0.0)).select("patient_number", evidence.evidence_summary().alias("s")).collect()
    assert [r["s"] is None for r in sorted(texts)] == [False, True]
    assert [r["patient_number"] for r in evidence.unexplained(df).collect()] == [2]


def test_respondents_without_edges_have_views(spark):
    df = explained(spark, [profile(), profile()])
    sizes = graph.view_sizes(graph.nodes(df, "forest"), graph.edges(df).filter("patient_number = 1"))
    lone = sizes.filter("patient_number = 2").collect()
    assert len(lone) == len(graph.VIEWS) and all(r["n_edges"] == 0 and r["n_nodes"] > 0 for r in lone)


def test_drafts_without_respondent_are_reported(spark):
    rows = evidence.with_warning(explained(spark), F.lit(0.0))
    drafts = spark.createDataFrame([(1, "x"), (77, "y")], "patient_number bigint, draft string")
    got = evidence.with_guidance(drafts.join(rows, "patient_number", "left")).collect()
    assert {r["patient_number"]: r["outcome"] for r in got} == {1: "replaced", 77: "no respondent"}


def test_repeated_keys_end_with_one_row(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (1, "c"), (2, "d")], "k int, v string")
    assert sorted(catalog.upsert(old, new, ["k"]).collect()) == [(1, "c"), (2, "d")]
    maps = spark.createDataFrame([(1, {"x": "1"}), (1, {"x": "2"})], "k int, properties map<string,string>")
    merged = catalog.upsert_properties(maps.limit(0), maps, ["k"]).collect()
    assert len(merged) == 1 and merged[0]["properties"] == {"x": "2"}
    edits = spark.createDataFrame([(1, 20.0), (1, 25.0)], "patient_number bigint, BMI double")
    assert [r["BMI"] for r in scenario.apply_overrides(profiles(spark, [profile()]), edits).collect()] == [25.0]
    assert one_per_key(new, ["k"], order="v").count() == 2


def test_numbered_rows_lie_in_ranges(spark):
    rows = spark.range(4000).withColumnRenamed("id", "rid")
    placed = numbering.number_respondents(rows, buckets=8).withColumn("_part", F.spark_partition_id())
    ranges = sorted((r["low"], r["high"]) for r in placed.groupBy("_part").agg(F.min("patient_number").alias("low"), F.max("patient_number").alias("high")).collect())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:])) and ranges[0][0] == 1 and ranges[-1][1] == 4000
    assert len(SHAP) == len(FEATURES)
