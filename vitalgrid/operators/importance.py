"""Permutation importance as one scoring job.

Every repeat uses one permutation of the rows for all features: each row gets a
donor row, and per feature the donor's value replaces the row's own. Rows are
numbered once, in the order of a digest (by digest ranges, so no ranking needs a
single-task window); a keyed bijection on the numbers, in column arithmetic,
names the donor of every row and repeat, so there is no second ranking.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.codebook import FEATURES
from vitalgrid.operators.metrics import cell_counts, macro_f1
from vitalgrid.operators.ordering import BUCKET, by_shuffle, hash_bucket, numbered
from vitalgrid.operators.split import hash_sample, row_digest
from vitalgrid.session import written

Scorer = Callable[[DataFrame], DataFrame]


def range_digits(spark: SparkSession) -> int:
    """Hex digits that cut digests into a few ranges per shuffle partition."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2, ceil(log(4 * partitions, 16)))


#: Rounds of the bijection.
ROUNDS = 24


def round_keys(seed: int, repeat: int, rounds: int = ROUNDS) -> list[int]:
    """Keys below 2 ** 31 that name one permutation."""
    return [int(md5(f"{seed}:{repeat}:{k}".encode()).hexdigest()[:8], 16) >> 1 for k in range(rounds)]


def shuffled(position: Column, n: Column, keys: Column) -> Column:
    """Image of a position 0..n-1 under the permutation of some keys (swap or not).

    A round pairs p with (key - p) mod n and swaps the two if a hash of the larger
    one says so; both members of a pair see the same hash, so each round, and all
    of them together, is a bijection for every n.
    """

    def turn(p: Column, key: Column) -> Column:
        other = F.pmod(key - p, n)
        mixed = F.pmod(F.greatest(p, other) + key, F.lit(1 << 31)) * 1103515245
        return F.when(F.getbit(mixed, F.lit(15)) == 1, other).otherwise(p)

    return F.aggregate(keys, position.cast("bigint"), turn)


def permuted_rows(
    df: DataFrame, label: str, repeats: int = 3, seed: int = 42, digits: int = 2
) -> DataFrame:
    """One row per (row, feature, repeat) with that feature's value taken from the donor.

    ``digits`` hex digits of the digest set the number of ranges (16 ** digits).
    """
    rows = df.select("rid", label, *FEATURES)
    ranged = rows.withColumn("_digest", row_digest(f"{seed}:base", "rid")).withColumn(BUCKET, hash_bucket(F.col("_digest"), digits))
    base = numbered(ranged, [F.col("_digest"), F.col("rid")], "_position").drop(BUCKET, "_digest")
    each = ", ".join(f"named_struct('repeat', {r}, '_keys', array({', '.join(f'{k}L' for k in round_keys(seed, r))}))" for r in range(repeats))
    asking = base.select("*", F.expr(f"inline(array({each}))")).withColumn("_n", rows.agg(F.count("*")).scalar())
    asking = asking.withColumn("_position", shuffled(F.col("_position") - 1, F.col("_n"), F.col("_keys")) + 1).drop("_keys", "_n")
    donors = base.select("_position", *[F.col(f).alias(f"_{f}") for f in FEATURES])
    paired = asking.join(by_shuffle(donors), "_position")
    names = ", ".join(f"'{f}'" for f in FEATURES)
    return paired.withColumn("feature", F.expr(f"explode(array({names}))")).selectExpr(
        "rid", label, "repeat", "feature", *[f"IF(feature = '{f}', _{f}, {f}) AS {f}" for f in FEATURES]
    )


def permutation_scores(
    df: DataFrame, score: Scorer, label: str, repeats: int = 3, seed: int = 42, digits: int = 2
) -> DataFrame:
    """Macro-F1 per (feature, repeat) after permuting that feature."""
    scored = score(permuted_rows(df, label, repeats, seed, digits))
    cells = scored.groupBy("feature", "repeat").agg(*cell_counts(F.col(label), F.col("predicted_class")))
    return cells.select("feature", "repeat", macro_f1().alias("macro_f1"))


def permutation_importance(
    df: DataFrame,
    score: Scorer,
    label: str,
    sample_size: int | None = None,
    repeats: int = 3,
    seed: int = 42,
    digits: int | None = None,
) -> DataFrame:
    """Mean and population deviation of the macro-F1 loss per feature.

    All rows of ``df`` take part, or ``sample_size`` of them where a protocol
    asks for that. The digest ranges follow the session's shuffle partitions.
    """
    if digits is None:
        digits = range_digits(df.sparkSession)
    rows = df
    if sample_size is not None:
        # the sample is read five times below; its selection should run once
        rows = written(hash_sample(df.select("rid", label, *FEATURES), sample_size, "rid", seed))
    whole = score(rows).agg(*cell_counts(F.col(label), F.col("predicted_class"))).select(
        macro_f1().alias("baseline")
    )
    losses = permutation_scores(rows, score, label, repeats, seed, digits).select(
        "feature", (whole.scalar() - F.col("macro_f1")).alias("loss")
    )
    return losses.groupBy("feature").agg(
        F.avg("loss").alias("importance_mean"), F.stddev_pop("loss").alias("importance_std")
    )
