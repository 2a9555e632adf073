"""Counting over all explanation graphs by their parts.

A built graph has 22 parts: one per feature (its four nodes and six edges), and
one for the respondent (all else). What a part says follows from few figures:
the feature's value and contribution and the predicted class, or the class, its
probabilities and the body mass index. So the respondents are counted by these
figures, each different part is read off the graph of one respondent who has it,
and it weighs as many respondents as share it. Every respondent is counted once
in each of the 22 parts; nothing wider than a part's key is ever moved.

Defined cases: respondents no graph can be built for (``graph.graph_ready``) are
in no part; rows that repeat a number count as often as they occur; an empty
table has no parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.codebook import FEATURES
from vitalgrid.functions.decode import slug_of
from vitalgrid.operators.graph import FEATURE_NODES, KEY, graph_ready

PART = "part"
#: Respondents with a part, and the sum of their numbers.
WEIGHT, NUMBERS = "n_respondents", "number_sum"
_N = len(FEATURES)


def parts(df: DataFrame) -> DataFrame:
    """``part, patient_number, n_respondents, number_sum`` of scored and explained rows; the number is one respondent's who has the part."""
    rows = [f"named_struct('part', {i}, 'a', {f}, 'b', get(shap, {i}), 'c', 0D, 'd', 0D)" for i, f in enumerate(FEATURES)]
    rows.append(f"named_struct('part', {_N}, 'a', BMI, 'b', get(probabilities, 0), 'c', get(probabilities, 1), 'd', get(probabilities, 2))")
    long = graph_ready(df)[0].selectExpr(KEY, "predicted_class", f"inline(array({', '.join(rows)}))")
    return (
        long.groupBy(PART, "predicted_class", "a", "b", "c", "d")
        .agg(F.min(KEY).alias("_own"), F.count(F.lit(1)).alias(WEIGHT), F.sum(KEY).alias(NUMBERS))
        .select(PART, F.col("_own").alias(KEY), WEIGHT, NUMBERS)
    )


def part_of_node(node_id: Column) -> Column:
    """The part a node id belongs to."""
    of = {prefix + slug_of(f): i for i, f in enumerate(FEATURES) for _, prefix, _, _ in FEATURE_NODES}
    known = F.expr("map(" + ", ".join(f"'{name}', {i}" for name, i in of.items()) + ")")
    return F.coalesce(F.try_element_at(known, node_id), F.lit(_N))


def part_of_edge(number: Column) -> Column:
    """The part an edge number belongs to: five edges a feature, and its contribution to the prediction."""
    first = 5 * _N + 5
    return (
        F.when(number <= 5 * _N, F.floor((number - 1) / 5))
        .when((number >= first) & (number < first + _N), number - first)
        .otherwise(_N)
        .cast("int")
    )


def weighed(rows: DataFrame, part: Column, found: DataFrame) -> DataFrame:
    """Rows of the graphs of ``found``'s respondents, each with the weight of its part; other parts of these graphs are left out.

    ``found`` has one row per different part, as have the graphs they are read off.
    """
    return rows.withColumn(PART, part).join(found, [KEY, PART])
