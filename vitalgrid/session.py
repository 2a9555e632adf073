"""Session settings, shared scratch folders and the one way this library cuts lineage."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, memory: str = "8g", app: str = "vitalgrid") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # call sites of every column expression cost more than planning does
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a local session (tests) gets a folder of its own when none is named; on
    a cluster a missing setting is an error, because a machine-local folder dies
    with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """A new path for one written table inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/table-{uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy.

    A written table outlives a lost executor, and later steps prune its columns.
    """
    path = run_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
