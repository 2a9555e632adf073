from pyspark.sql import functions as F

from vitalgrid.operators import catalog, graph, graph_parts, graph_rows
from vitalgrid.operators.graph_parts import NUMBERS, WEIGHT, part_of_edge, part_of_node
from vitalgrid.plans import graph_queries
from vitalgrid.plans.derived import contributed

KEY = "patient_number"


def rows_of(df):
    return sorted(map(repr, df.collect()))


def copies(spark, tiny):
    """Respondents of whom many share parts, one of them twice."""
    rows = contributed(spark, tiny).limit(200)
    return rows.unionByName(rows.filter(f"{KEY} = 7"))


def test_every_respondent_is_once_in_each_part(spark, tiny):
    df = copies(spark, tiny)
    found = graph_parts.parts(df)
    sums = {r["part"]: (r["n"], r["s"]) for r in found.groupBy("part").agg(F.sum(WEIGHT).alias("n"), F.sum(NUMBERS).alias("s")).collect()}
    whole = df.agg(F.count("*"), F.sum(KEY)).first()
    assert sums == {part: tuple(whole) for part in range(22)}


def test_parts_of_undrawable_respondents_are_absent(spark, tiny):
    df = contributed(spark, tiny).limit(50).withColumn("Age", F.when(F.col(KEY) % 2 == 0, 3.5).otherwise(F.col("Age")))
    kept = df.filter(f"{KEY} % 2 = 1").count()
    assert {r[0] for r in graph_parts.parts(df).groupBy("part").agg(F.sum(WEIGHT)).select(f"sum({WEIGHT})").collect()} == {kept}
    assert graph_parts.parts(df.limit(0)).count() == 0


def test_weighed_edges_and_nodes_equal_the_whole_tables(spark, tiny):
    df = contributed(spark, tiny).limit(300)
    found = graph_parts.parts(df).persist()
    own = df.join(found.select(KEY).distinct(), KEY, "left_semi")
    doomed = (F.col("type") == "State") & (F.col("label") == "Obesity")

    def counted(node_table, edge_table, weight):
        nodes, edges = catalog.detach_delete(node_table, edge_table, doomed, [KEY])
        return rows_of(nodes.groupBy("id", "label").agg(weight(nodes).alias("n"))), rows_of(edges.groupBy("source", "relationship", "label").agg(weight(edges).alias("n")))

    nodes, edges = catalog.detach_delete(graph.nodes(own, "forest"), graph.edges(own), doomed, [KEY])
    nodes = graph_parts.weighed(nodes, part_of_node(F.col("id")), found)
    edges = graph_parts.weighed(edges, part_of_edge(F.col("edge_number")), found)
    got = (
        rows_of(nodes.groupBy("id", "label").agg(F.sum(WEIGHT).alias("n"))),
        rows_of(edges.groupBy("source", "relationship", "label").agg(F.sum(WEIGHT).alias("n"))),
    )
    assert got == counted(graph.nodes(df, "forest"), graph.edges(df), lambda _: F.count(F.lit(1)))


def test_delete_moves_no_long_table(spark, tiny):
    """The long tables of all respondents are neither built nor joined: they are read off those who stand for a part."""
    df = graph_queries.detach_delete(spark, tiny)
    assert "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.agg(F.sum("n_rows")).first()[0] > 100_000


def test_stored_snapshot_holds_those_who_stand_for_a_part(spark, tiny, monkeypatch):
    """No long table of all respondents is packed, and the counts equal those over all of them."""
    packed = []
    monkeypatch.setattr(graph_rows, "write_packed", lambda graphs, path: (packed.append(graphs.count()), graphs.write.parquet(path)))
    got = graph_queries.stored_connections(spark, tiny)
    rows = contributed(spark, tiny)
    whole = graph_rows.connections(graph_rows.packed(rows, graph_queries.MODEL))
    by = ["node", "direction", "edge_label", "other", "other_label"]
    want = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(KEY).alias("number_sum"))
    assert rows_of(got) == rows_of(want)
    assert packed[0] < rows.count()


def test_neighbourhoods_with_repeated_and_missing_ends(spark):
    nodes = [("a", "A", "t", 1), None, ("a", "again", "t", 1), ("b", "B", "t", 1)]
    edges = [(1, "a", "b", "r", "l", 0, 3), (2, "b", "a", "r", "l", 3, 0), (3, "a", "gone", "r", "l", 0, None), (4, "b", "b", "r", "l", 3, 3)]
    graphs = spark.createDataFrame([(1, nodes, edges)], f"{KEY} bigint, nodes {graph_rows._NODE_TYPE}, edges {graph_rows._EDGE_TYPE}")
    pairs = [(r["node"], r["neighbour"]) for r in graph_rows.neighbourhoods(graphs).collect()]
    assert sorted(pairs) == [("a", "a"), ("a", "b"), ("a", "gone"), ("b", "a"), ("b", "b"), ("gone", "a")]


def test_outline_has_the_shape_of_built_graphs(spark, tiny):
    df = contributed(spark, tiny).limit(3)
    full = graph_rows.packed(df, "forest")
    shape = graph_rows.outline(df.select(KEY))

    def fixed(graphs):
        return graphs.select(
            KEY, F.transform("nodes", lambda n: F.struct(n["id"], n["type"], n["bits"])),
            F.transform("edges", lambda e: F.struct(e["edge_number"], e["source"], e["target"], e["source_at"], e["target_at"])),
        )

    assert rows_of(fixed(full)) == rows_of(fixed(shape))
    assert rows_of(graph_rows.view_sizes(full)) == rows_of(graph_rows.view_sizes(shape))


def test_trained_graphs_are_sized_without_building_them(spark, tiny, monkeypatch):
    monkeypatch.setattr(graph_rows, "packed", None)
    rows = graph_queries.trained_to_graph(spark, tiny)
    assert {(r["adds_up"], r["n_nodes"], r["n_edges"]) for r in rows.collect()} == {(True, 98, 135)}


def test_explanation_view_has_every_relationship_of_every_feature(spark, tiny):
    rows = graph_queries.explanation_view(spark, tiny).filter("target = 'prediction-current' AND source LIKE 'contribution-%'").collect()
    kinds = {"SUPPORTS_PREDICTION", "OPPOSES_PREDICTION", "NEUTRAL_FOR_PREDICTION"}
    seen = {r["source"]: set() for r in rows}
    for r in rows:
        seen[r["source"]].add(r["relationship"])
    assert len(seen) == 21 and all({"SUPPORTS_PREDICTION", "OPPOSES_PREDICTION"} <= s <= kinds for s in seen.values())


def test_explanation_view_explains_every_respondent_by_the_forest_too(spark, tiny):
    """The forest's own contributions, counted over the graphs of all respondents, stand beside the made ones."""
    got = graph_queries.explanation_view(spark, tiny)
    edges = graph_rows.visible_edges(graph_rows.packed(contributed(spark, tiny), graph_queries.MODEL), "explanation")
    by = ["source", "target", "relationship"]
    want = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("n_edges"))
    assert rows_of(got.filter("explained_by = 'forest'").select(*by, "n_edges")) == rows_of(want)
    made = got.filter("explained_by = 'made'")
    assert made.count() > want.count() and made.agg(F.sum("n_edges")).first() == want.agg(F.sum("n_edges")).first()
