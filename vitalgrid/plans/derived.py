"""Survey-shaped inputs derived from the driver's tables.

There is no survey among the given tables, so one is computed from every row of
``orders``: same columns, same domains, skewed classes. A second view spoils it
for the cleaning policies. Both grow with ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.codebook import FEATURES, TARGET
from vitalgrid.functions.settle import settled
from vitalgrid.operators.forest import Forest, Node, score
from vitalgrid.operators.numbering import NUMBER
from vitalgrid.operators.shapley import with_shap

# Multiplier per column and, for binary ones, the share of ones.
_MODULUS = 1000003
_BINARY = {
    "HighBP": (7919, 43), "HighChol": (104729, 42), "CholCheck": (1299709, 96), "Smoker": (32452843, 44),
    "Stroke": (49979687, 4), "HeartDiseaseorAttack": (67867967, 9), "PhysActivity": (86028121, 76),
    "Fruits": (104395301, 63), "Veggies": (122949823, 81), "HvyAlcoholConsump": (141650939, 6),
    "AnyHealthcare": (160481183, 95), "NoDocbcCost": (179424673, 8), "DiffWalk": (256203161, 17),
    "Sex": (275604541, 44),
}
_CODED = {"GenHlth": (198491317, 5), "Age": (295075147, 13), "Education": (314606869, 6), "Income": (334214459, 8)}
_DAYS = {"MentHlth": 217645177, "PhysHlth": 236887691}
_BMI = 15485863
_NOISE = 353868013


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def survey(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``rid``, 21 features and the target for every order; reads one column, or ``keep`` too.

    The given file is a single row group, which is a single task, and tables made
    from it are up to a hundred times its size; its key column is therefore dealt
    over the session's shuffle partitions, whatever its size.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", *keep).repartition(partitions, "o_orderkey")
    return survey_from(orders, keep)


def survey_from(orders: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    columns = {}
    for name, (multiplier, percent) in _BINARY.items():
        columns[name] = f"CASE WHEN {_spread(multiplier)} % 100 < {percent} THEN 1D ELSE 0D END"
    for name, (multiplier, top) in _CODED.items():
        columns[name] = f"CAST(1 + {_spread(multiplier)} % {top} AS DOUBLE)"
    for name, multiplier in _DAYS.items():
        day = _spread(multiplier)
        columns[name] = f"CASE WHEN {day} % 100 < 60 THEN 0D ELSE CAST({day} % 31 AS DOUBLE) END"
    columns["BMI"] = f"14D + {_spread(_BMI)} % 73 * 0.5D"
    columns["_noise"] = f"{_spread(_NOISE)} % 4"
    base = settled(
        orders.select(F.col("o_orderkey").alias("rid"), *keep),
        {name: columns[name] for name in [*FEATURES, "_noise"]},
    )
    points = (
        "2 * HighBP + HighChol + IF(BMI >= 30, 2, 0) + IF(Age >= 9, 1, 0) + IF(GenHlth >= 4, 2, 0) + _noise"
    )
    label = f"CASE WHEN {points} >= 9 THEN 2D WHEN {points} = 8 AND rid % 5 = 0 THEN 1D ELSE 0D END"
    return settled(base, {TARGET: label}).select("rid", *keep, *FEATURES, TARGET)


def _spread(multiplier: int) -> str:
    return f"(((rid + 1) * {multiplier}) % {_MODULUS})"


def raw_survey(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The survey as spoiled text: blanks, words, wrong codes, wrong labels."""
    spoiled = {c: f"CAST({c} AS STRING)" for c in [*FEATURES, TARGET]}
    spoiled["BMI"] = (
        "CASE WHEN rid % 101 = 0 THEN '' WHEN rid % 101 = 1 THEN 'n/a' WHEN rid % 101 = 2 THEN '1f' "
        "WHEN rid % 101 = 3 THEN 'NaN' ELSE CAST(BMI AS STRING) END"
    )
    spoiled["MentHlth"] = "CASE WHEN rid % 89 <> 0 THEN CAST(MentHlth AS STRING) END"
    spoiled["HighBP"] = "CASE WHEN rid % 997 = 0 THEN '2' ELSE CAST(HighBP AS STRING) END"
    spoiled[TARGET] = (
        f"CASE WHEN rid % 53 = 0 THEN NULL WHEN rid % 991 = 0 THEN '3.0' WHEN rid % 983 = 0 THEN '1.5' "
        f"ELSE CAST({TARGET} AS STRING) END"
    )
    return settled(survey(spark, sf_dir, keep), spoiled)


def _leaf(cover: float, *weights: float) -> Node:
    return Node(cover, tuple(float(w) for w in weights))


def _split(feature: str, threshold: float, left: Node, right: Node) -> Node:
    cover = left.cover + right.cover
    return Node(cover, (), feature, threshold, left, right)


def demo_forest() -> Forest:
    """Four small trees with dyadic leaf shares, so scores are exact in any engine."""
    return Forest(
        (
            _split(
                "HighBP", 0.5,
                _split("GenHlth", 3.5, _leaf(24, 60, 1, 3), _leaf(8, 40, 4, 20)),
                _split("BMI", 29.75, _leaf(16, 36, 4, 24), _leaf(16, 16, 4, 44)),
            ),
            _split(
                "BMI", 29.75,
                _split("Age", 8.5, _leaf(24, 58, 2, 4), _leaf(16, 38, 4, 22)),
                _split("GenHlth", 2.5, _leaf(8, 44, 4, 16), _leaf(16, 14, 6, 44)),
            ),
            _split(
                "GenHlth", 3.5,
                _split("HighChol", 0.5, _leaf(28, 56, 2, 6), _leaf(20, 40, 4, 20)),
                _split("HighBP", 0.5, _leaf(6, 34, 6, 24), _leaf(10, 10, 6, 48)),
            ),
            _split(
                "BMI", 24.75,
                _leaf(16, 60, 2, 2),
                _split(
                    "BMI", 34.75,
                    _leaf(32, 40, 4, 20),
                    _split("HighBP", 0.5, _leaf(8, 28, 4, 32), _leaf(8, 8, 4, 52)),
                ),
            ),
        )
    )


def demo_score(df: DataFrame) -> DataFrame:
    return score(df, demo_forest())


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every respondent scored by the demonstration forest; number = rid + 1."""
    return demo_score(survey(spark, sf_dir)).withColumn(NUMBER, F.col("rid") + 1)


# First cut, step and number of cuts of the features that are not binary.
_CUTS = {
    "BMI": (22.25, 3, 7), "MentHlth": (2.5, 4, 5), "PhysHlth": (2.5, 4, 5), "GenHlth": (1.5, 1, 4),
    "Age": (2.5, 2, 5), "Education": (2.5, 1, 4), "Income": (2.5, 1, 5),
}
WIDE_TREES = 8


def wide_nodes(spark: SparkSession) -> DataFrame:
    """Node table of eight trees of depth 4 that split on all 21 features; leaf shares are dyadic, covers are not."""
    rows = []
    for tree in range(WIDE_TREES):
        weights: dict[int, list[float]] = {}
        for leaf in range(16):
            low = (7 * tree + 11 * leaf + 3) % 29
            medium = (5 * tree + 13 * leaf) % (33 - low)
            scale = float(1 << (tree + leaf) % 3)
            weights[15 + leaf] = [scale * low, scale * medium, scale * (32 - low - medium)]
        for node in reversed(range(15)):
            weights[node] = [a + b for a, b in zip(weights[2 * node + 1], weights[2 * node + 2])]
        for node in range(31):
            if node >= 15:
                rows.append((tree, node, -1, -1, None, None, weights[node]))
                continue
            index = (4 * tree + 5 * node + tree * node) % len(FEATURES)
            first, step, cuts = _CUTS.get(FEATURES[index], (0.5, 0, 1))
            rows.append((tree, node, 2 * node + 1, 2 * node + 2, index, first + step * ((tree + node) % cuts), weights[node]))
    return spark.createDataFrame(
        rows, "tree bigint, node bigint, left_node bigint, right_node bigint, feature_index int, threshold double, weights array<double>"
    )


#: Contributions are rounded to multiples of 2 ** -30, so that sums of them are exact in any order and engine.
_GRID = float(1 << 30)


def explained(rows: DataFrame) -> DataFrame:
    """Scored rows with ``shap``: contributions of the demonstration forest to the predicted class."""
    found = with_shap(rows, demo_forest()).withColumnRenamed("shap", "_shap")
    return settled(found, {"shap": f"transform(_shap, x -> CAST(floor(x * {_GRID}D + 0.5D) AS DOUBLE) / {_GRID}D)"}).drop("_shap")


def made_contributions(rows: DataFrame) -> DataFrame:
    """Scored rows with made contributions as ``shap``: zeros, ties and both signs for every feature, from the row id alone."""
    values = [f"CAST((rid + 1) * {31 + 17 * i} % 401 - 200 AS DOUBLE) / 1024" for i in range(len(FEATURES))]
    return settled(rows, {"shap": f"array({', '.join(values)})"})


def contributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored and explained respondents."""
    return explained(scored(spark, sf_dir))
