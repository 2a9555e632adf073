import duckdb
import pytest

import __spark_entry__ as entry_module
from check_queries import TABLES, rows_of
from vitalgrid.plans import registry

ROWS_ONLY = {"forest_report"}
# one query per module at least; check_queries.py runs all of them
COMPARED = [
    "class_summary", "clean_strict", "import_rule_counts", "single_profiles", "csv_import", "neighbour_windows",
    "decode_profiles", "stratified_split", "classification_report", "auc_by_class", "permutation_importance",
    "shap_contributions", "supports_and_opposes", "scenario_scores", "case_records", "graph_edges", "graph_views",
    "catalog_usage", "catalog_versions", "refreshed_twins", "upload_audit", "audited_import", "shap_wide_forest", "shap_additivity", "forest_supports",
    "trained_to_graph", "reloaded_model", "import_guards", "evidence_documents", "importance_ranking", "property_merge", "graph_quarantine", "stale_twins", "current_twins", "evidence_summaries", "draft_checks", "guidance", "stream_scores",
]


def test_every_query_has_sql():
    assert set(registry.queries()) - set(registry.oracles()) == ROWS_ONLY
    assert set(registry.oracles()) <= set(registry.queries())


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["class_id", "label", "n_rows", "percentage"]
    assert df.count() == 3


# queries that take a part of the rows only where there are more than at the smallest scale
LARGER = ["permutation_importance"]


@pytest.mark.parametrize(("name", "sf"), [(n, "sf0.001") for n in COMPARED] + [(n, "sf0.01") for n in LARGER])
def test_query_equals_sql(spark, tiny, name, sf):
    tables = tiny.replace("sf0.001", sf)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    df = registry.queries()[name](spark, tables)
    result = con.execute(registry.oracles()[name])
    columns = [d[0] for d in result.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())
