"""Reading survey tables: CSV as text, Parquet as typed columns, uploads by folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgrid.codebook import FEATURES, TARGET
from vitalgrid.session import written


class MissingColumns(ValueError):
    """The table lacks required columns or has columns it must not have."""


def missing_columns(df: DataFrame, with_target: bool = False) -> list[str]:
    """Required names the table lacks, sorted. Looks at the schema only."""
    required = set(FEATURES) | ({TARGET} if with_target else set())
    return sorted(required - set(df.columns))


def extra_columns(df: DataFrame, bookkeeping: tuple[str, ...] = ()) -> list[str]:
    """Names beyond the features, sorted; ``bookkeeping`` names do not count."""
    return sorted(set(df.columns) - set(FEATURES) - set(bookkeeping))


def require_columns(df: DataFrame, with_target: bool = False) -> None:
    missing = missing_columns(df, with_target)
    if missing:
        raise MissingColumns(f"missing required columns: {', '.join(missing)}")


def require_exact_columns(df: DataFrame, bookkeeping: tuple[str, ...] = ()) -> None:
    missing, extra = missing_columns(df), extra_columns(df, bookkeeping)
    if missing or extra:
        raise MissingColumns(f"columns must be exactly the features; missing: {missing}; extra: {extra}")


def project(df: DataFrame, keep: tuple[str, ...] = ("rid",)) -> DataFrame:
    """Bookkeeping columns, then features in fixed order, then the target if there is one."""
    kept = [c for c in keep if c in df.columns]
    return df.select(*kept, *FEATURES, *([TARGET] if TARGET in df.columns else []))


_CSV_FILES = "*.[cC][sS][vV]"
ROW_ID, SOURCE, PLACE = "rid", "source_name", "source_row"


def read_csv(spark: SparkSession, path: str, source_names: bool = False, row_ids: bool = False) -> DataFrame:
    """Survey CSV with a header; every column stays text until a cleaning policy runs.

    The header decides the column names. Schema inference is off: no extra pass
    over the data, and bad text survives to the cleaning step. ``path`` may be a
    folder; only ``*.csv`` files (any case) are taken. Files of one folder share
    a header: a file whose header differs is an error when it is read, never a
    swap of values; ``read_uploads`` takes such folders. ``row_ids`` adds what
    ``with_row_ids`` does.
    """
    df = _csv(spark).csv(path)
    return _placed(df, source_names, row_ids)


def read_uploads(spark: SparkSession, path: str, row_ids: bool = False) -> DataFrame:
    """Files of one folder with the same columns in any order, one read per different header.

    Costs one more pass over the text, for the first line of every file. A
    column that a file lacks is NULL for its rows.
    """
    lines = spark.read.option("pathGlobFilter", _CSV_FILES).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    # one row per file, as many as the scan itself keeps on the driver
    files: dict[str, list[str]] = {}
    for row in first.orderBy("file").collect():
        files.setdefault(row["header"], []).append(row["file"])
    parts = [_placed(_csv(spark).csv(same), True, row_ids=False, keep=True) for same in files.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return with_row_ids(out) if row_ids else out.drop("_file", "_block", "_line")


def audit_files(spark: SparkSession, path: str | list[str], exact: bool = False, single: bool = False) -> DataFrame:
    """One row per file: ``file, source_name, header, columns, missing, extra, n_rows, verdict``.

    ``missing`` and ``extra`` are sorted names; a target column is not extra
    unless ``exact``. The verdict is the first that holds of ``empty`` (no row
    after the header), ``repeated`` (a column name that occurs twice),
    ``missing``, ``extra`` (only when ``exact``), ``several`` (only when
    ``single``: more than one row), and else ``ok``. Files are told apart by
    path; nothing of one file is held together but its counts and its first line.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", _CSV_FILES).load(path).select(F.col("path").alias("_path"))
    lines = spark.read.option("pathGlobFilter", _CSV_FILES).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    # blocks of a file are read in any order: its first line is the first one of the block at 0
    first = F.min_by("value", F.when(F.col("start") == 0, F.col("line")))
    counted = lines.groupBy("file").agg(first.alias("header"), F.count_if(F.trim("value") != "").alias("n_lines"))

    def plain(name: Column) -> Column:
        return F.regexp_replace(F.trim(name), r'^\ufeff?"?|"$', "")

    def same_file(p: Column) -> Column:
        return F.regexp_replace(p, "^file:/+", "file:/")

    names = F.transform(F.split(F.coalesce("header", F.lit("")), ","), plain)
    features = F.array(*[F.lit(f) for f in FEATURES])
    allowed = features if exact else F.array_append(features, F.lit(TARGET))
    judged = (
        listed.join(counted, same_file(F.col("_path")) == same_file(F.col("file")), "left")
        .select(F.col("_path").alias("file"), F.element_at(F.split("_path", "/"), -1).alias(SOURCE), "header", names.alias("columns"),
                F.greatest(F.coalesce(F.col("n_lines"), F.lit(0)) - 1, F.lit(0)).alias("n_rows"))
        .withColumns(
            {"missing": F.array_sort(F.array_except(features, "columns")), "extra": F.array_sort(F.array_except("columns", allowed))}
        )
    )
    verdict = F.when(F.col("n_rows") == 0, "empty").when(F.size(F.array_distinct("columns")) < F.size("columns"), "repeated")
    verdict = verdict.when(F.size("missing") > 0, "missing")
    if exact:
        verdict = verdict.when(F.size("extra") > 0, "extra")
    if single:
        verdict = verdict.when(F.col("n_rows") > 1, "several")
    return judged.withColumn("verdict", verdict.otherwise("ok"))


def read_audited(spark: SparkSession, path: str | list[str], exact: bool = False, single: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of the files that pass the audit, as text with ``source_name``, and the audit of all files.

    A bad file is named in the audit and its rows stay out; the others load,
    whatever the order of their columns. Without a good file there are no rows.
    """
    audit = written(audit_files(spark, path, exact, single))
    # one row per file, as many as the scan itself keeps on the driver
    files: dict[str, list[str]] = {}
    for row in audit.filter("verdict = 'ok'").orderBy("file").collect():
        files.setdefault(row["header"], []).append(row["file"])
    wanted = [*FEATURES, SOURCE]
    out = None
    for same in files.values():
        part = _placed(_csv(spark).option("ignoreLeadingWhiteSpace", True).csv(same), True, row_ids=False)
        part = part.select(*wanted, *([TARGET] if TARGET in part.columns else []))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        out = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in wanted))
    return out, audit


def _csv(spark: SparkSession):
    return spark.read.option("header", True).option("enforceSchema", False).option("pathGlobFilter", _CSV_FILES)


def _placed(df: DataFrame, source_names: bool, row_ids: bool, keep: bool = False) -> DataFrame:
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")]
    named = [F.col("_metadata.file_name").alias(SOURCE)]
    df = df.select("*", *(named if source_names or row_ids or keep else []), *(place if row_ids or keep else []))
    return with_row_ids(df) if row_ids else df


def with_row_ids(df: DataFrame) -> DataFrame:
    """Add ``rid`` and ``source_row``: 1-based positions over all files by name, and within the row's own file.

    Rows keep file order: blocks of a file by their start, rows of a block as
    they were read. One task reads a block from its start to its end, so a row's
    place there is the distance of its line number from the block's smallest, and
    no row is moved; one small row per block (as many as the scan has splits, in
    the driver too) carries that and the counts of the blocks before it.
    """
    counts = df.groupBy(SOURCE, "_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_line").alias("_first"))
    over_all = Window.orderBy(SOURCE, "_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        "_file", "_block", "_first",
        F.coalesce(F.sum("_n").over(over_all), F.lit(0)).alias("_all"),
        F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_own"),
    )
    placed = df.join(F.broadcast(before), ["_file", "_block"])
    at = F.col("_line") - F.col("_first") + 1
    return placed.withColumns({ROW_ID: at + F.col("_all"), PLACE: at + F.col("_own")}).drop(
        "_file", "_block", "_line", "_first", "_all", "_own"
    )
