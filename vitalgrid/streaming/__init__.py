"""Cleaning and scoring of arriving files with Structured Streaming.

Both steps look at one row at a time, so they run unchanged on a stream; no
state, watermark or window is involved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vitalgrid.operators.clean import training_clean


def arriving(
    spark: SparkSession, folder: str, schema: StructType | str, files: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Parquet files of a folder, by name pattern, as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def clean_and_score(df: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return score(training_clean(df).valid)


def write_scored(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Score everything that has arrived, exactly once, and stop.

    ``checkpoint`` belongs in the shared folder of the cluster.
    """
    return (
        clean_and_score(stream, score)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
