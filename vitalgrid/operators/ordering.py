"""Positions and running totals over tables of any size.

A window without partitions would put the whole table into one task. Here the
ordering key is cut into ranges first; each range is ordered on its own, and
one row per range carries the totals of all ranges before it.
"""

from __future__ import annotations

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgrid.session import written

BUCKET = "_bucket"


def by_shuffle(df: DataFrame) -> DataFrame:
    """Mark a side that grows with the respondents, so that it is never broadcast.

    Size estimates do not see that a generator turns one row into a hundred, so
    a table made by one can pass for small and be sent to every executor whole.
    """
    return df.hint("merge")


def range_bucket(df: DataFrame, key: str, buckets: int | None = None, bounds_from: DataFrame | None = None) -> DataFrame:
    """Add ``_bucket``, which never falls as the numeric ``key`` rises.

    Bounds are approximate quantiles of ``key``, taken from ``bounds_from`` when
    given (for example the bare id column of the source, the cheapest scan that
    has it). They decide only how even the ranges are, never the result.
    """
    spark = df.sparkSession
    n = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = df if bounds_from is None else bounds_from
    fitted = QuantileDiscretizer(
        numBuckets=n, inputCol="_key", outputCol=BUCKET, relativeError=min(0.01, 0.2 / n)
    ).fit(source.select(F.col(key).cast("double").alias("_key")))
    ranged = fitted.transform(df.withColumn("_key", F.col(key).cast("double")))
    return ranged.withColumn(BUCKET, F.col(BUCKET).cast("int")).drop("_key")


def one_per_key(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the last by ``order``, ties and no order by the largest values in column order.

    Columns that cannot be compared (maps) count by their JSON text.
    """
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    ranked = [F.to_json(c) if df.schema[c].dataType.typeName() == "map" else F.col(c) for c in others]
    rank = F.struct(*([F.col(order)] if order else []), *ranked)
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others]).select(*df.columns)


def hash_bucket(hexdigest: Column, digits: int = 3) -> Column:
    """Range of an evenly spread hex digest: its first digits as a number."""
    return F.conv(F.substring(hexdigest, 1, digits), 16, 10).cast("int")


def running_totals(
    df: DataFrame,
    order_by: list[Column],
    totals: dict[str, str],
    within: list[str] | None = None,
) -> DataFrame:
    """Inclusive running sums ``{new column: summed column}`` in ``order_by`` order.

    ``df`` carries ``_bucket`` (ranges in the same order). ``within`` restarts
    the sums per group. Two aggregates' worth of work: totals per range (small,
    map-side combined), then a window inside each range.
    """
    groups = within or []
    per_range = df.groupBy(*groups, BUCKET).agg(
        *[F.sum(col).alias(f"_t_{name}") for name, col in totals.items()]
    )
    # one row per range and group: bounded by the number of ranges, not rows
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(BUCKET).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = per_range.select(
        *groups,
        BUCKET,
        *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in totals],
    )
    inside = Window.partitionBy(*groups, BUCKET).orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = df.select("*", *[F.sum(col).over(inside).alias(f"_l_{name}") for name, col in totals.items()])
    joined = local.join(F.broadcast(offsets), [*groups, BUCKET])
    added = {name: F.col(f"_l_{name}") + F.col(f"_o_{name}") for name in totals}
    return joined.withColumns(added).drop(
        *[f"_l_{name}" for name in totals], *[f"_o_{name}" for name in totals]
    )


def numbered(df: DataFrame, order_by: list[Column], out: str) -> DataFrame:
    """1-based positions over a bucketed table.

    The rows are written once, with the place of each in its range: what they
    are made of is not worked out again to count the ranges.
    """
    inside = Window.partitionBy(BUCKET).orderBy(*order_by)
    placed = written(df.withColumn("_place", F.row_number().over(inside).cast("bigint")))
    # one row per range
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(BUCKET, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), BUCKET).withColumn(out, F.col("_place") + F.col("_before")).drop("_place", "_before")


def _edge_range(rows: DataFrame, quota: DataFrame, key: str) -> DataFrame:
    """Per group the range in which its ``quota`` runs out, and how many rows of it (``_take``) are wanted."""
    counts = rows.groupBy(key, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(key).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.least(F.col("quota"), F.sum("_n").over(Window.partitionBy(key)))
    return (
        counts.join(F.broadcast(quota), key)
        .select(key, BUCKET, "_n", F.sum("_n").over(upto).alias("_upto"), wanted.alias("_wanted"))
        .filter((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_n") < F.col("_wanted")))
        .select(key, BUCKET, (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_take"))
    )


def smallest_by_hash(
    df: DataFrame,
    quotas: DataFrame,
    digest: Column,
    tie: str,
    group: str | None = None,
    digits: int = 4,
) -> DataFrame:
    """Mark, per group, the ``quota`` rows with the smallest digests as ``chosen``.

    No row is moved: counts per digest range find the one range in which each
    group's quota runs out; counts of the next digits find the range inside it;
    the few rows of that one are ordered to get the cut-off digest, and the
    cut-offs (one row per group) are compared row by row.
    ``quotas`` has one row per group with the column ``quota``.
    """
    key = group or "_all"
    base = df if group else df.withColumn("_all", F.lit(0))
    quota = quotas if group else quotas.withColumn("_all", F.lit(0))
    slim = base.select(key, F.col(tie).alias("_tie"), digest.alias("_digest")).withColumn(
        BUCKET, hash_bucket(F.col("_digest"), digits)
    )
    edge = _edge_range(slim, quota, key)
    inner = slim.join(F.broadcast(edge), [key, BUCKET]).drop(BUCKET, "_take").withColumn(
        BUCKET, F.conv(F.substring("_digest", digits + 1, digits), 16, 10).cast("int")
    )
    edge = _edge_range(inner, edge.select(key, F.col("_take").alias("quota")), key)
    order = Window.partitionBy(key).orderBy("_digest", "_tie")
    cut = (
        inner.join(F.broadcast(edge), [key, BUCKET])
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == F.col("_take"))
        .select(key, F.struct("_digest", "_tie").alias("_cut"))
    )
    chosen = F.coalesce(F.struct(digest.alias("_digest"), F.col(tie).alias("_tie")) <= F.col("_cut"), F.lit(False))
    marked = base.join(F.broadcast(cut), key, "left").withColumn("chosen", chosen).drop("_cut")
    return marked if group else marked.drop("_all")
