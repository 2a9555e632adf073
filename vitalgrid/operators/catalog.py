"""Reusable definition tables and keyed maintenance of stored tables.

Parquet has no in-place update, so a merge or a delete gives the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.operators.ordering import by_shuffle, one_per_key
from vitalgrid.sources import dimensions as dim

# Node label -> unique key property.
UNIQUE_KEYS = {
    "Domain": "key",
    "AttributeDefinition": "key",
    "ValueDefinition": "id",
    "CategoryDefinition": "id",
    "ModelVersion": "name",
    "ModelEvaluation": "id",
}
# Names of the two concepts an older schema left behind.
OBSOLETE_CONCEPTS = ["Insulin Resistance", "Increased T2DM Risk"]


def _node_rows(df: DataFrame, node_label: str, key: str, properties: list[str]) -> DataFrame:
    pairs = [part for p in properties for part in (F.lit(p), F.col(p).cast("string"))]
    every = F.create_map(*pairs).cast("map<string,string>")
    filled = F.map_filter(every, lambda _, v: v.isNotNull())
    return df.select(
        F.lit(node_label).alias("node_label"), F.col(key).cast("string").alias("node_key"), filled.alias("properties")
    )


def catalog_nodes(spark: SparkSession, evaluation: DataFrame) -> DataFrame:
    """Domains, attributes, values, BMI categories, models and their evaluations."""
    values = dim.value_definitions(spark)
    categories = dim.bmi_ranges(spark)
    return (
        _node_rows(dim.domains(spark), "Domain", "domain", ["domain_label"])
        .unionByName(
            _node_rows(dim.attributes(spark), "AttributeDefinition", "feature", ["label", "kind", "display_order"])
        )
        .unionByName(_node_rows(values, "ValueDefinition", "value_id", ["code", "label"]))
        .unionByName(
            _node_rows(
                categories, "CategoryDefinition", "category_id",
                ["code", "label", "minimum", "maximum", "display_order"],
            )
        )
        .unionByName(_node_rows(evaluation, "ModelVersion", "model_name", []))
        .unionByName(
            _node_rows(
                evaluation.withColumn("id", F.concat("model_name", F.lit(":evaluation"))),
                "ModelEvaluation",
                "id",
                [c for c in evaluation.columns if c != "model_name"],
            )
        )
    )


def catalog_edges(spark: SparkSession, evaluation: DataFrame) -> DataFrame:
    """The four relationship types between definition nodes."""

    def rows(df: DataFrame, relation: str, source: tuple[str, Column], target: tuple[str, Column]) -> DataFrame:
        return df.select(
            F.lit(source[0]).alias("source_label"),
            source[1].alias("source_key"),
            F.lit(relation).alias("relationship"),
            F.lit(target[0]).alias("target_label"),
            target[1].alias("target_key"),
        )

    attribute = ("AttributeDefinition", F.col("feature"))
    return (
        rows(dim.attributes(spark), "BELONGS_TO", attribute, ("Domain", F.col("domain")))
        .unionByName(
            rows(dim.value_definitions(spark), "DECODES_TO", attribute, ("ValueDefinition", F.col("value_id")))
        )
        .unionByName(
            rows(
                dim.bmi_ranges(spark), "CLASSIFIED_AS", ("AttributeDefinition", F.lit("BMI")),
                ("CategoryDefinition", F.col("category_id")),
            )
        )
        .unionByName(
            rows(
                evaluation, "EVALUATED_BY", ("ModelVersion", F.col("model_name")),
                ("ModelEvaluation", F.concat("model_name", F.lit(":evaluation"))),
            )
        )
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot after merging ``new`` into ``old``: new values win, old rows stay.

    Running it again with the same ``new`` changes nothing. Of several new rows
    with one key, the one with the largest values in column order wins.
    """
    new = one_per_key(new, keys)
    columns = list(dict.fromkeys([*old.columns, *new.columns]))

    def marked(df: DataFrame, mark: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{mark}{c}") for c in df.columns if c not in keys])

    joined = marked(old, "_o_").join(marked(new, "_n_"), keys, "full_outer")

    def pick(name: str) -> Column:
        sides = [f"{mark}{name}" for mark, df in (("_n_", new), ("_o_", old)) if name in df.columns]
        return F.coalesce(*[F.col(s) for s in sides]).alias(name)

    return joined.select(*[F.col(c) if c in keys else pick(c) for c in columns])


def merged_properties(old: Column, new: Column) -> Column:
    """Property map after laying ``new`` over ``old``; a NULL value removes the property."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_filter(F.map_concat(kept, new), lambda _, v: v.isNotNull())


def upsert_properties(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Merge of two tables with a ``properties`` map, property by property.

    Of several new rows with one key, the map with the largest JSON text counts.
    """
    new = one_per_key(new, keys)
    empty = F.create_map().cast("map<string,string>")
    joined = old.withColumnRenamed("properties", "_o").join(
        new.withColumnRenamed("properties", "_n"), keys, "full_outer"
    )
    return joined.select(
        *keys,
        merged_properties(F.coalesce("_o", empty), F.coalesce("_n", empty)).alias("properties"),
    )


def detach_delete(
    nodes: DataFrame, edges: DataFrame, doomed: Column, group: list[str], node_id: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """Nodes without the doomed ones, and edges without any that touched them."""
    gone = nodes.filter(doomed).select(*group, F.col(node_id).alias("_gone")).distinct()
    kept_nodes = nodes.filter(~F.coalesce(doomed, F.lit(False)))
    if not group:
        # one graph for the whole table: its doomed ids may be many, so each end is joined
        for end in ("source", "target"):
            edges = edges.join(by_shuffle(gone.withColumnRenamed("_gone", end)), end, "left_anti").select(*edges.columns)
        return kept_nodes, edges
    # a group's doomed ids are few, so both ends are settled by one join on the group
    listed = gone.groupBy(*group).agg(F.collect_set("_gone").alias("_gone"))
    touched = F.array_contains("_gone", F.col("source")) | F.array_contains("_gone", F.col("target"))
    kept_edges = edges.join(by_shuffle(listed), group, "left").filter(~F.coalesce(touched, F.lit(False)))
    return kept_nodes, kept_edges.select(*edges.columns)


def is_obsolete() -> Column:
    """Predicate of nodes an older schema left behind."""
    return (F.col("node_label") == "BmiCategory") | (
        (F.col("node_label") == "HealthConcept") & F.col("name").isin(OBSOLETE_CONCEPTS)
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; empty when the keys are unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
