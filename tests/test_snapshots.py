"""Stored tables that change, the versions of the catalog, and the audit of uploads."""

import pytest
from pyspark.sql import functions as F

from vitalgrid.codebook import FEATURES, TARGET
from vitalgrid.operators import catalog, scenario
from vitalgrid.plans.derived import survey
from vitalgrid.session import run_folder
from vitalgrid.sources import snapshots, survey as source
from vitalgrid.sources.artifacts import write_csv

TWIN = "patient_number bigint, bmi double, gender string, risk_percent double"


def files_of(spark, path):
    rows = spark.read.parquet(path).select(snapshots.BUCKET, F.col("_metadata.file_name").alias("f")).distinct().collect()
    return {(r["bucket"], r["f"]) for r in rows}


def test_a_refresh_rewrites_only_buckets_with_stale_rows(spark):
    path = run_folder(spark)
    old = spark.createDataFrame([(i, 20.0 + i, "male", 50.0) for i in range(200)], TWIN)
    snapshots.write_bucketed(old, path, "patient_number", 16)
    before = files_of(spark, path)
    assert len({b for b, _ in before}) == 16
    new = old.withColumn("risk_percent", F.col("risk_percent") + F.when(F.col("patient_number").isin(3, 77), 1.0).otherwise(0.00005))
    new = new.unionByName(spark.createDataFrame([(500, 1.0, "female", 2.0), (500, 1.0, "female", 1.0)], TWIN))
    stale = snapshots.refresh(new, path, "patient_number", 16, scenario.needs_refresh)
    assert sorted(r[0] for r in stale.select("patient_number").collect()) == [3, 77, 500, 500]
    touched = {r[0] for r in spark.createDataFrame([(3,), (77,), (500,)], "k bigint").select(snapshots.bucket_of("k", 16)).collect()}
    after = files_of(spark, path)
    assert {x for x in after if x[0] not in touched} == {x for x in before if x[0] not in touched}
    assert not {f for b, f in after if b in touched} & {f for _, f in before}
    got = {r["patient_number"]: r["risk_percent"] for r in snapshots.read_bucketed(spark, path).collect()}
    assert got == {i: 51.0 if i in (3, 77) else 50.0 for i in range(200)} | {500: 2.0}
    again = snapshots.refresh(new.filter("patient_number < 500"), path, "patient_number", 16, scenario.needs_refresh)
    assert again.count() == 0 and files_of(spark, path) == after


def definitions(spark, accuracy=0.8):
    evaluation = spark.createDataFrame([("forest", accuracy)], "model_name string, accuracy double")
    return catalog.catalog_nodes(spark, evaluation), catalog.catalog_edges(spark, evaluation)


def test_versions_cleanup_and_reload(spark):
    path = run_folder(spark)
    nodes, edges = snapshots.read_catalog(spark, path)
    assert nodes.count() == edges.count() == 0 and snapshots.current_version(spark, path) is None
    left_behind = spark.createDataFrame(
        [("BmiCategory", "x", {"a": "1"}), ("HealthConcept", "i", {"name": "Insulin Resistance"}), ("HealthConcept", "s", {"name": "Sleep"}),
         ("ModelVersion", "forest", {"note": "old", "accuracy": "0.1"})], "node_label string, node_key string, properties map<string,string>",
    )
    links = spark.createDataFrame(
        [("HealthConcept", "s", "ABOUT", "BmiCategory", "x"), ("HealthConcept", "i", "ABOUT", "HealthConcept", "s"), ("HealthConcept", "s", "ABOUT", "ModelVersion", "forest")],
        ", ".join(f"{c} string" for c in snapshots.EDGE_KEYS),
    )
    assert snapshots.write_catalog(left_behind, links, path) == 0
    assert [snapshots.reload_catalog(*definitions(spark), path) for _ in range(2)] == [1, 2]
    log = {r["version"]: r for r in snapshots.versions(spark, path).collect()}
    assert log[1]["digest"] == log[2]["digest"] != log[0]["digest"] and [log[v]["parent"] for v in range(3)] == [None, 0, 1]
    nodes, edges = snapshots.read_catalog(spark, path)
    held = {(r["node_label"], r["node_key"]): r["properties"] for r in nodes.collect()}
    assert ("BmiCategory", "x") not in held and ("HealthConcept", "i") not in held and ("HealthConcept", "s") in held
    assert held["ModelVersion", "forest"] == {"note": "old", "accuracy": "0.1"}
    assert [r["target_key"] for r in edges.filter("relationship = 'ABOUT'").collect()] == ["forest"]
    assert snapshots.reload_catalog(*definitions(spark, 0.9), path) == 3
    old, _ = snapshots.read_catalog(spark, path, 2)
    assert old.filter("node_key = 'forest:evaluation'").first()["properties"] == {"accuracy": "0.8"}


def test_broken_definitions_and_failed_writers_leave_the_current_version(spark):
    path = run_folder(spark)
    nodes, edges = definitions(spark)
    snapshots.reload_catalog(nodes, edges, path)
    with pytest.raises(snapshots.CatalogRefused, match="one key"):
        snapshots.reload_catalog(nodes.unionByName(nodes.filter("node_label = 'Domain'")), edges, path)
    with pytest.raises(snapshots.CatalogRefused, match="unknown kind"):
        snapshots.reload_catalog(nodes.unionByName(nodes.limit(1).withColumn("node_key", F.lit(None).cast("string"))), edges, path)
    with pytest.raises(snapshots.CatalogRefused, match="is no node"):
        snapshots.reload_catalog(nodes, edges.unionByName(edges.limit(1).withColumn("target_key", F.lit("nowhere"))), path)
    broken = edges.withColumn("target_key", F.when(F.rand() >= 0, F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        snapshots.write_catalog(nodes.limit(1), broken, path)
    assert snapshots.current_version(spark, path) == 0
    assert snapshots.read_catalog(spark, path)[0].count() == nodes.count()
    assert snapshots.write_catalog(nodes, edges, path) == 1
    assert snapshots.versions(spark, path).agg(F.count_distinct("digest")).first()[0] == 1


def test_audit_of_files_of_every_kind(spark, tiny):
    base = run_folder(spark)
    rows = survey(spark, tiny).limit(6).coalesce(1)
    write_csv(rows.select(*reversed(FEATURES)), f"{base}/a")
    write_csv(rows.select(TARGET, *FEATURES), f"{base}/b")
    write_csv(rows.select(FEATURES[1:]), f"{base}/c")
    write_csv(rows.select(*FEATURES, F.col("rid").alias("more")), f"{base}/d")
    write_csv(rows.limit(0).select(FEATURES), f"{base}/e")
    write_csv(rows.limit(1).select(FEATURES), f"{base}/f")
    folders = [f"{base}/{k}" for k in "abcdef"]

    def verdicts(**how):
        audit = source.audit_files(spark, folders, **how)
        return {r["file"].split("/")[-2]: (r["verdict"], r["missing"], r["extra"], r["n_rows"]) for r in audit.collect()}

    assert verdicts() == {
        "a": ("ok", [], [], 6), "b": ("ok", [], [], 6), "c": ("missing", [FEATURES[0]], [], 6), "d": ("ok", [], ["more"], 6),
        "e": ("empty", [], [], 0), "f": ("ok", [], [], 1),
    }
    exact = verdicts(exact=True, single=True)
    assert {k: v[0] for k, v in exact.items()} == {"a": "several", "b": "extra", "c": "missing", "d": "extra", "e": "empty", "f": "ok"}
    good, audit = source.read_audited(spark, folders)
    assert good.count() == 19 and audit.count() == 6
    want = sorted(tuple(r) for r in rows.select(FEATURES).collect())
    ordered = good.select([F.col(f).cast("double") for f in FEATURES]).groupBy(*FEATURES).count()
    assert sorted(tuple(r)[:-1] for r in ordered.collect()) == sorted(set(want))
    none, _ = source.read_audited(spark, [f"{base}/c", f"{base}/e"])
    assert none.count() == 0 and set(FEATURES) <= set(none.columns)
