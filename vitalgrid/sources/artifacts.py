"""Readers and writers for the files around a model: metrics, importance, results."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from vitalgrid.codebook import FEATURES

# Layout of the metrics document.
_CLASS = "struct<precision:double,recall:double,`f1-score`:double,support:double>"
METRICS_SCHEMA = (
    "n_rows bigint, n_train bigint, n_test bigint, class_counts map<string,bigint>, "
    "accuracy double, balanced_accuracy double, macro_f1 double, weighted_f1 double, "
    "macro_ovr_roc_auc double, classification_report struct<"
    f"`Low`:{_CLASS},`Medium (prediabetes)`:{_CLASS},`High (diabetes)`:{_CLASS},"
    f"accuracy:double,`macro avg`:{_CLASS},`weighted avg`:{_CLASS}>"
)
IMPORTANCE_SCHEMA = "feature string, importance_mean double, importance_std double"


def _or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    """The table, or an empty one of the same schema when the path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics document as one row; a missing or corrupt file gives no row."""

    def read():
        whole = spark.read.text(path, wholetext=True)
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        parsed = whole.select(F.from_json("value", f"{METRICS_SCHEMA}, _corrupt string", options).alias("m"))
        return parsed.select("m.*").filter(F.col("_corrupt").isNull()).drop("_corrupt")

    return _or_empty(spark, read, METRICS_SCHEMA)


def evaluation_row(metrics: DataFrame, model_name: str) -> DataFrame:
    """The evaluation figures attached to every prediction of one model."""
    report = F.col("classification_report")
    return metrics.select(
        F.lit(model_name).alias("model_name"),
        "accuracy",
        "balanced_accuracy",
        "macro_f1",
        F.col("macro_ovr_roc_auc").alias("macro_roc_auc"),
        report["Low"]["recall"].alias("low_recall"),
        report["Medium (prediabetes)"]["recall"].alias("medium_recall"),
        report["High (diabetes)"]["recall"].alias("high_recall"),
    )


def ranked_importance(importance: DataFrame) -> DataFrame:
    """Rank from 1 by mean, ties in feature order (21 rows, one small window)."""
    order = F.array_position(F.array(*[F.lit(f) for f in FEATURES]), F.col("feature"))
    window = Window.orderBy(F.desc("importance_mean"), order)
    return importance.select("*", F.row_number().over(window).alias("importance_rank"))


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    """Importance CSV with its rank; a missing file gives an empty table."""
    return ranked_importance(
        _or_empty(
            spark,
            lambda: spark.read.schema(IMPORTANCE_SCHEMA).option("header", True).csv(path),
            IMPORTANCE_SCHEMA,
        )
    )


def write_json_documents(df: DataFrame, path: str, document: Column | None = None, compression: str = "none") -> None:
    """One JSON document per row; NULL fields are kept as null. Many alike documents are worth a ``compression``."""
    body = F.struct("*") if document is None else document
    df.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path, compression=compression)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet snapshot. Partition columns must have few values (band, type)."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_twins(twins: DataFrame, path: str) -> None:
    """Twin descriptors as JSON records, one folder per risk band (three values).

    Records keep their band, and name the mesh file a renderer would write.
    """
    twins.select(
        "patient_number", "bmi", "risk_percent", "gender", "risk_band",
        F.col("risk_colour").alias("risk_color"),
        F.concat(F.lit("patient_"), F.col("patient_number").cast("string"), F.lit(".obj")).alias("mesh_file"),
        F.col("risk_band").alias("band"),
    ).write.mode("overwrite").partitionBy("band").json(path)


def save_model(model: RandomForestClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(path)
