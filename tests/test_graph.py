from pyspark.sql import functions as F

from examples import SHAP, explained, profile
from vitalgrid.codebook import FEATURES
from vitalgrid.operators import catalog, graph, graph_rows
from vitalgrid.plans import derived
from vitalgrid.plans.derived import contributed
from vitalgrid.session import run_folder


def evaluation(spark, medium=0.001):
    return spark.createDataFrame(
        [("forest", 0.8, 0.45, 0.44, 0.75, 0.9, medium, 0.45)],
        "model_name string, accuracy double, balanced_accuracy double, macro_f1 double, macro_roc_auc double, "
        "low_recall double, medium_recall double, high_recall double",
    )


def test_complete_graph_of_one_respondent(spark):
    df = explained(spark)
    nodes = graph.nodes(df, "forest", None, evaluation(spark)).collect()
    edges = graph.edges(df).collect()
    assert len(nodes) == 98 and len(edges) == 135
    kinds = {}
    for n in nodes:
        kinds[n["type"]] = kinds.get(n["type"], 0) + 1
    assert kinds == {
        "PatientSnapshot": 1, "Domain": 6, "Observation": 21, "AttributeDefinition": 21, "State": 21,
        "ShapContribution": 21, "Prediction": 1, "RiskProbability": 3, "ModelVersion": 1, "ModelEvaluation": 1,
        "DigitalTwin": 1,
    }
    by_id = {n["id"]: n for n in nodes}
    assert len(by_id) == 98
    assert by_id["observation-bmi"]["parent"] == "domain-clinical"
    assert by_id["state-bmi"]["label"] == "Obesity"
    labels = {n["label"] for n in nodes}
    assert not labels & set(catalog.OBSOLETE_CONCEPTS)
    assert by_id["contribution-highbp"]["label"] == "HighBP SHAP +0.310"
    assert by_id["contribution-highchol"]["summary"] == "HighChol opposes the predicted class in this model output."
    assert by_id["probability-2"]["label"] == "High (diabetes): 50.0%"
    assert by_id["probability-2"]["details"]["selected"] is True
    assert "0.10%" in by_id["model-evaluation"]["details"]["warning"]
    twin = by_id["digital-twin-current"]["details"]
    assert (twin["bmi"], twin["beta0"], twin["risk_percent"], twin["risk_band"]) == (33.5, 5.75, 50.0, "Moderate")
    probabilities = {n["details"]["class_id"]: n["details"]["probability"] for n in nodes if n["type"] == "RiskProbability"}
    assert probabilities == {0: 0.30, 1: 0.20, 2: 0.50}


def test_edge_numbers_ends_and_signs(spark):
    df = explained(spark)
    edges = {e["edge_number"]: e for e in graph.edges(df).collect()}
    assert sorted(edges) == list(range(1, 136))
    assert edges[1]["id"] == "edge-1" and edges[1]["target"] == "observation-highbp"
    assert (edges[106]["source"], edges[106]["target"]) == ("patient-current", "prediction-current")
    assert [edges[i]["weight"] for i in (107, 108, 109)] == [0.30, 0.20, 0.50]
    assert [edges[i]["relationship"] for i in (110, 111, 112)] == [
        "SUPPORTS_PREDICTION", "OPPOSES_PREDICTION", "NEUTRAL_FOR_PREDICTION",
    ]
    assert edges[111]["weight"] == 0.17 and edges[111]["shap_value"] == -0.17
    assert edges[135]["target"] == "probability-2" and edges[134]["target"] == "observation-bmi"
    nodes = graph.nodes(df, "forest")
    assert graph.dangling_edges(nodes, graph.edges(df)).count() == 0
    assert graph.dangling_edges(nodes.filter("id <> 'probability-2'"), graph.edges(df)).count() == 2


def test_rows_that_cannot_be_drawn_are_reported(spark):
    odd = profile()
    odd["Age"] = 2.5
    df = explained(spark, [profile(), odd])
    df = df.unionByName(df.filter("rid = 0").withColumns({"rid": F.lit(9), "shap": F.slice("shap", 1, 20)}))
    ready, rest = graph.graph_ready(df)
    assert [r["rid"] for r in ready.collect()] == [0]
    reasons = {r["rid"]: (list(r["missing_shap"]), list(r["undecodable"])) for r in rest.collect()}
    assert reasons == {1: ([], ["Age"]), 9: (["Income"], [])}


def test_views_neighbourhoods_and_connections(spark):
    df = explained(spark, [profile(), profile(20.0)])
    nodes, edges = graph.nodes(df, "forest"), graph.edges(df)
    sizes = {(r["patient_number"], r["view"]): (r["n_nodes"], r["n_edges"]) for r in graph.view_sizes(nodes, edges).collect()}
    assert sizes[(1, "all")] == (98, 135) and len(sizes) == 10
    for view in graph.VIEWS:
        assert graph.visible_nodes(nodes, view).filter("patient_number = 1").count() == sizes[(1, view)][0]
        assert graph.visible_edges(nodes, edges, view).filter("patient_number = 1").count() == sizes[(1, view)][1]
    near = graph.neighbourhoods(nodes, edges).filter("patient_number = 1 AND node = 'digital-twin-current'")
    assert {r["neighbour"] for r in near.collect()} == {
        "digital-twin-current", "patient-current", "observation-bmi", "probability-2",
    }
    faded = graph.faded_nodes(nodes, edges, "digital-twin-current").filter("patient_number = 1")
    assert faded.count() == 94
    seen = graph.connections(nodes, edges)
    assert seen.count() == 2 * 270 and seen.filter("other_label IS NULL").count() == 0
    mine = seen.filter("patient_number = 1 AND node = 'state-bmi'").collect()
    assert [(r["direction"], r["edge_label"], r["other_label"]) for r in mine] == [
        ("in", "decoded as", "Body mass index (BMI): 33.5"),
    ]


def test_detach_delete_leaves_no_dangling_edge(spark):
    df = explained(spark)
    nodes, edges = graph.nodes(df, "forest"), graph.edges(df)
    kept, left = catalog.detach_delete(nodes, edges, F.col("type") == "Observation", ["patient_number"])
    assert kept.count() == 77 and left.count() == 135 - 4 * 21 - 1
    assert graph.dangling_edges(kept, left).count() == 0


def test_obsolete_nodes_of_an_older_schema(spark):
    nodes = spark.createDataFrame(
        [("1", "BmiCategory", "x"), ("2", "HealthConcept", "Insulin Resistance"), ("3", "HealthConcept", "Sleep"), ("4", "Domain", None)],
        "id string, node_label string, name string",
    )
    edges = spark.createDataFrame([("1", "3"), ("3", "2"), ("3", "4")], "source string, target string")
    kept, left = catalog.detach_delete(nodes, edges, catalog.is_obsolete(), [])
    assert sorted(r["id"] for r in kept.collect()) == ["3", "4"]
    assert [tuple(r) for r in left.collect()] == [("3", "4")]


def test_catalog_is_complete_unique_and_reload_changes_nothing(spark):
    e = evaluation(spark).drop("macro_f1")
    nodes, edges = catalog.catalog_nodes(spark, e), catalog.catalog_edges(spark, e)
    counts = {r["node_label"]: r["count"] for r in nodes.groupBy("node_label").count().collect()}
    assert counts == {
        "Domain": 6, "AttributeDefinition": 21, "ValueDefinition": 60, "CategoryDefinition": 4, "ModelVersion": 1,
        "ModelEvaluation": 1,
    }
    assert set(counts) == set(catalog.UNIQUE_KEYS)
    assert edges.groupBy("relationship").count().count() == 4 and edges.count() == 21 + 60 + 4 + 1
    assert catalog.duplicate_keys(nodes, ["node_label", "node_key"]).count() == 0
    keys = ["node_label", "node_key"]
    again = catalog.upsert_properties(nodes, nodes, keys)
    before = sorted((r["node_key"], sorted(r["properties"].items())) for r in nodes.collect())
    assert sorted((r["node_key"], sorted(r["properties"].items())) for r in again.collect()) == before


def test_property_merge_removes_nulls_and_upsert_keeps_old_rows(spark):
    old = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", {"x": "3"})], "k string, properties map<string,string>")
    new = spark.createDataFrame([("a", {"x": None, "z": "5"}), ("c", {"q": "6"})], "k string, properties map<string,string>")
    got = {r["k"]: r["properties"] for r in catalog.upsert_properties(old, new, ["k"]).collect()}
    assert got == {"a": {"y": "2", "z": "5"}, "b": {"x": "3"}, "c": {"q": "6"}}
    o = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k bigint, n string, v double")
    n = spark.createDataFrame([(2, 5.0, True), (3, 6.0, True)], "k bigint, v double, f boolean")
    merged = {r["k"]: (r["n"], r["v"], r["f"]) for r in catalog.upsert(o, n, ["k"]).collect()}
    assert merged == {1: ("a", 1.0, None), 2: ("b", 5.0, True), 3: (None, 6.0, True)}


def test_building_the_graph_shuffles_nothing(spark, tiny):
    orders = spark.read.parquet(f"{tiny}/orders.parquet")
    rows = derived.explained(derived.demo_score(derived.survey_from(orders)).withColumn("patient_number", F.col("rid") + 1))
    for table in (graph.nodes(rows, "forest"), graph.edges(rows)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
    assert len(SHAP) == len(FEATURES)


def plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_packed_graphs_equal_the_tables(spark, tiny):
    """Built in the row, or packed from the tables: the same answers as from the tables themselves."""
    df = contributed(spark, tiny).filter("rid < 400")
    nodes, edges = graph.nodes(df, "forest"), graph.edges(df)
    in_row, from_tables = graph_rows.packed(df, "forest"), graph_rows.from_tables(nodes, edges)
    columns = ["patient_number", "edge_number", "source", "target", "relationship", "label"]
    for graphs in (in_row, from_tables):
        assert rows_of(graph_rows.view_sizes(graphs)) == rows_of(graph.view_sizes(nodes, edges))
        for view in graph.VIEWS:
            assert rows_of(graph_rows.visible_edges(graphs, view).select(columns)) == rows_of(graph.visible_edges(nodes, edges, view).select(columns))
        assert rows_of(graph_rows.connections(graphs)) == rows_of(graph.connections(nodes, edges))
        assert rows_of(graph_rows.neighbourhoods(graphs)) == rows_of(graph.neighbourhoods(nodes, edges))
        faded = graph_rows.faded_nodes(graphs, graph.TWIN).select("patient_number", "id", "type", "label")
        assert rows_of(faded) == rows_of(graph.faded_nodes(nodes, edges, graph.TWIN).select("patient_number", "id", "type", "label"))
        left = graph_rows.dangling_edges(graph_rows.without_nodes(graphs, lambda n: n["type"] == "State"))
        assert rows_of(left.select(columns)) == rows_of(graph.dangling_edges(nodes.filter("type <> 'State'"), edges).select(columns))


def test_packed_graphs_need_no_exchange(spark, tiny):
    stored = run_folder(spark)
    graph_rows.write_packed(graph_rows.packed(scored_rows := contributed(spark, tiny).filter("rid < 50"), "forest"), stored)
    made = spark.read.parquet(_stored(scored_rows))
    for graphs in (graph_rows.packed(made, "forest"), graph_rows.read_packed(spark, stored)):
        for df in (
            graph_rows.view_sizes(graphs), graph_rows.visible_edges(graphs, "twin"), graph_rows.connections(graphs),
            graph_rows.neighbourhoods(graphs), graph_rows.faded_nodes(graphs, graph.PATIENT), graph_rows.dangling_edges(graphs),
        ):
            assert "Exchange" not in plans(df)
    assert "PushedFilters: [IsNotNull(patient_number), EqualTo(patient_number,7)]" in plans(graph_rows.read_packed(spark, stored).filter("patient_number = 7"))


def _stored(df):
    path = run_folder(df.sparkSession)
    df.write.parquet(path)
    return path


def test_odd_tables_are_packed(spark):
    """Nodes without edges, edges without nodes, an id that repeats, and no rows at all."""
    df = explained(spark)
    nodes, edges = graph.nodes(df, "forest"), graph.edges(df)
    only_nodes = graph_rows.from_tables(nodes, edges.limit(0))
    assert graph_rows.view_sizes(only_nodes).filter("view = 'all'").first()["n_nodes"] == 98
    only_edges = graph_rows.from_tables(nodes.limit(0), edges)
    assert graph_rows.dangling_edges(only_edges).count() == 135 and graph_rows.view_sizes(only_edges).first()["n_edges"] == 0
    twice = graph_rows.from_tables(nodes.unionByName(nodes), edges)
    assert graph_rows.connections(twice).count() == 270
    assert graph_rows.from_tables(nodes.limit(0), edges.limit(0)).count() == 0
    assert graph_rows.packed(df.limit(0), "forest").count() == 0
