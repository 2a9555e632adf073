"""Stored tables that change: only buckets with stale rows are rewritten, and the definition catalog has versions.

Parquet has no update in place. A large table is stored in buckets of its key,
so a change rewrites the files of the buckets it touches and of no other. The
small definition catalog is stored whole under a new version number; one row in
its log, written last, makes a version the current one, so a writer that fails
leaves the version before it as it was. One writer at a time is assumed.

Defined cases: a refresh without stale rows writes nothing; keys that are new
are stale; of several new rows with one key the one with the largest values in
column order counts; a path without a table reads as an empty catalog.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from vitalgrid.operators.catalog import UNIQUE_KEYS, detach_delete, duplicate_keys, is_obsolete, upsert, upsert_properties
from vitalgrid.operators.ordering import by_shuffle
from vitalgrid.session import written

BUCKET = "bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, key: str, buckets: int) -> None:
    placed = df.withColumn(BUCKET, bucket_of(key, buckets))
    writer = placed.repartition(BUCKET).sortWithinPartitions(BUCKET, key).write.mode("overwrite").partitionBy(BUCKET)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Store a table in ``buckets`` of its key, sorted within; choose them so that one bucket fits a task."""
    _write(df, path, key, buckets)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def refresh(new: DataFrame, path: str, key: str, buckets: int, stale_of: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Bring a bucketed table up to date with ``new`` and return the rows that were stale, written.

    ``stale_of(new, stored)`` tells which new rows differ from what is stored.
    Only buckets that hold stale rows are read again and replaced.
    """
    spark = new.sparkSession
    stored = spark.read.parquet(path)
    stale = written(stale_of(new, stored.drop(BUCKET)))
    # at most one row per bucket
    touched = stale.select(bucket_of(key, buckets).alias(BUCKET)).distinct()
    if stale.isEmpty():
        return stale
    old = stored.join(F.broadcast(touched), BUCKET, "left_semi").drop(BUCKET)
    # written first: the files that are read must not be the ones that are replaced
    _write(written(upsert(old, stale.select(*[c for c in stale.columns if c in old.columns]), [key])), path, key, buckets)
    return stale


# --- versions of the catalog ------------------------------------------------------

NODE_KEYS = ["node_label", "node_key"]
EDGE_KEYS = ["source_label", "source_key", "relationship", "target_label", "target_key"]
_NODES = "node_label string, node_key string, properties map<string,string>"
_EDGES = ", ".join(f"{c} string" for c in EDGE_KEYS)
_LOG = "version bigint, parent bigint, n_nodes bigint, n_edges bigint, digest bigint"


class CatalogRefused(ValueError):
    """The incoming definitions break a rule of the catalog."""


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The log: one row per version, with its parent, its size and a digest of its content."""
    try:
        return spark.read.schema(_LOG).parquet(f"{path}/log")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _LOG)


def current_version(spark: SparkSession, path: str) -> int | None:
    return versions(spark, path).agg(F.max("version").alias("v")).first()["v"]


def read_catalog(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a version, or of the current one; empty where there is none."""
    version = current_version(spark, path) if version is None else version
    if version is None:
        return spark.createDataFrame([], _NODES), spark.createDataFrame([], _EDGES)
    at = f"{path}/version-{version}"
    return spark.read.schema(_NODES).parquet(f"{at}/nodes"), spark.read.schema(_EDGES).parquet(f"{at}/edges")


def _digest(nodes: DataFrame, edges: DataFrame) -> int:
    """Sum of row hashes: equal for equal content in any order."""
    pairs = F.to_json(F.array_sort(F.map_entries("properties")))
    rows = nodes.select(F.xxhash64(*NODE_KEYS, pairs).alias("h")).unionByName(edges.select(F.xxhash64(*EDGE_KEYS).alias("h")))
    return rows.agg(F.sum(F.shiftrightunsigned("h", 16)).alias("d")).first()["d"] or 0


def write_catalog(nodes: DataFrame, edges: DataFrame, path: str) -> int:
    """Store a new version; it becomes current with its row in the log."""
    spark = nodes.sparkSession
    parent = current_version(spark, path)
    version = 0 if parent is None else parent + 1
    at = f"{path}/version-{version}"
    # files a failed writer may have left under this number are replaced
    nodes.select(*NODE_KEYS, "properties").write.mode("overwrite").parquet(f"{at}/nodes")
    edges.select(*EDGE_KEYS).distinct().write.mode("overwrite").parquet(f"{at}/edges")
    kept_nodes, kept_edges = read_catalog(spark, path, version)
    row = (version, parent, kept_nodes.count(), kept_edges.count(), _digest(kept_nodes, kept_edges))
    spark.createDataFrame([row], _LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return version


def broken_rules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``rule, what``: nodes of an unknown kind or without key, keys that repeat, edges with an end that is no node."""
    odd = nodes.filter(~F.col("node_label").isin(*UNIQUE_KEYS) | F.col("node_key").isNull()).select(
        F.lit("unknown kind or no key").alias("rule"), F.concat_ws(":", *NODE_KEYS).alias("what")
    )
    twice = duplicate_keys(nodes, NODE_KEYS).select(F.lit("key repeats").alias("rule"), F.concat_ws(":", *NODE_KEYS).alias("what"))
    found = odd.unionByName(twice)
    for side in ("source", "target"):
        ends = edges.select(F.col(f"{side}_label").alias("node_label"), F.col(f"{side}_key").alias("node_key")).distinct()
        loose = ends.join(by_shuffle(nodes.select(*NODE_KEYS)), NODE_KEYS, "left_anti")
        found = found.unionByName(loose.select(F.lit(f"{side} is no node").alias("rule"), F.concat_ws(":", *NODE_KEYS).alias("what")))
    return found


def without_obsolete(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes an older schema left behind are gone, and every edge that touched them."""
    def name(label: str, key: str) -> Column:
        return F.to_json(F.struct(F.col(label).alias("l"), F.col(key).alias("k")))

    named = nodes.withColumns({"id": name("node_label", "node_key"), "name": F.try_element_at("properties", F.lit("name"))})
    ended = edges.withColumns({"source": name("source_label", "source_key"), "target": name("target_label", "target_key")})
    kept, left = detach_delete(named, ended, is_obsolete(), [])
    return kept.drop("id", "name"), left.drop("source", "target")


def reload_catalog(nodes: DataFrame, edges: DataFrame, path: str) -> int:
    """Merge definitions into the current version and store the next: cleanup, keyed merge, rules, write.

    Loading the same definitions again gives a version of the same content.
    """
    spark = nodes.sparkSession
    old_nodes, old_edges = without_obsolete(*read_catalog(spark, path))
    repeated = duplicate_keys(nodes, NODE_KEYS).limit(5).collect()
    if repeated:
        raise CatalogRefused(f"definitions with one key: {[':'.join(map(str, r[:2])) for r in repeated]}")
    merged = written(upsert_properties(old_nodes, nodes.select(*NODE_KEYS, "properties"), NODE_KEYS))
    linked = written(old_edges.unionByName(edges.select(*EDGE_KEYS)).distinct())
    # what an older version holds beyond the known kinds stays; the rules are for what comes in
    known = merged.filter(F.col("node_label").isin(*UNIQUE_KEYS) | F.col("node_key").isNull())
    broken = broken_rules(known, edges.select(*EDGE_KEYS)).limit(5).collect()
    if broken:
        raise CatalogRefused("; ".join(f"{r['rule']}: {r['what']}" for r in broken))
    return write_catalog(merged, linked, path)
