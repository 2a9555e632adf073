"""Explanation graph of every respondent as a node table and an edge table.

Each respondent contributes 98 nodes and 135 edges. Both tables come from two
projections of the scored rows - one per respondent, one per respondent and
feature - so building them shuffles nothing; only global importance and the
model's evaluation are broadcast. Keys are ``(patient_number, id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid import codebook as cb
from vitalgrid.codebook import FEATURES
from vitalgrid.functions.decode import slug_of
from vitalgrid.functions.numeric import filled, percent_text, signed_text
from vitalgrid.functions.risk import (
    class_label,
    direction,
    model_warning,
    relationship,
    risk_band,
    risk_colour,
    shape_coefficient,
)
from vitalgrid.operators.contributions import attribute_entries, undecodable
from vitalgrid.operators.lookups import with_evaluation, with_importance
from vitalgrid.operators.ordering import by_shuffle

KEY = "patient_number"

# Detail fields a node may carry, with their types.
DETAIL_FIELDS = {
    "persistence": "string", "feature_count": "int", "feature": "string", "kind": "string",
    "domain": "string", "raw_value": "double", "decoded_state": "string", "rule": "string",
    "importance_rank": "int", "importance_mean": "double", "importance_std": "double",
    "shap_value": "double", "shap_direction": "string", "meaning": "string",
    "predicted_class": "int", "high_risk_probability": "double", "class_id": "int",
    "probability": "double", "selected": "boolean", "artifact": "string", "accuracy": "double",
    "balanced_accuracy": "double", "macro_f1": "double", "macro_roc_auc": "double",
    "low_recall": "double", "medium_recall": "double", "high_recall": "double",
    "warning": "string", "bmi": "double", "beta0": "double", "risk_percent": "double",
    "risk_band": "string", "color": "string",
}
EVALUATION_FIELDS = [
    "accuracy", "balanced_accuracy", "macro_f1", "macro_roc_auc", "low_recall", "medium_recall", "high_recall",
]
# The views of the graph.
VIEWS = ["all", "profile", "explanation", "prediction", "twin"]
PATIENT = "patient-current"
PREDICTION = "prediction-current"
MODEL = "model-current"
EVALUATION = "model-evaluation"
TWIN = "digital-twin-current"


def _slot_case(slots: dict[str, Column]) -> Column:
    """Value by node or edge slot; NULL for slots not named."""
    expr = F.lit(None)
    for slot, value in slots.items():
        expr = F.when(F.col("slot") == slot, value).otherwise(expr)
    return expr


def _node_columns(label: Column, summary: Column, parent: Column, details: dict[str, Column]) -> list[Column]:
    fields = [details.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in DETAIL_FIELDS.items()]
    return [
        F.col(KEY),
        F.col("id"),
        label.alias("label"),
        F.col("type"),
        F.col("groups"),
        summary.alias("summary"),
        parent.cast("string").alias("parent"),
        F.struct(*fields).alias("details"),
    ]


def _templates(rows: list[tuple], names: list[str]) -> Column:
    """Constant rows as one literal array, to be laid beside every input row."""
    return F.inline(
        F.array(
            *[
                F.struct(
                    *[
                        (F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)).alias(name)
                        for name, value in zip(names, row)
                    ]
                )
                for row in rows
            ]
        )
    )


def graph_ready(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows a graph can be built for, and the others with their reasons."""
    lacking = F.array_compact(
        F.array(*[F.when(F.get("shap", F.lit(i)).isNull(), f) for i, f in enumerate(FEATURES)])
    )
    judged = df.withColumns({"missing_shap": lacking, "undecodable": undecodable()})
    good = (F.size("missing_shap") == 0) & (F.size("undecodable") == 0)
    return judged.filter(good).drop("missing_shap", "undecodable"), judged.filter(~good)


def feature_rows(df: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    """One decoded row per respondent and feature, with the parts of its node ids.

    Everything that depends on the feature alone is a constant looked up by
    position, so no table is joined unless there is a global importance.
    """
    entries = attribute_entries(
        {
            "feature": {f: f for f in FEATURES},
            "part": {f: slug_of(f) for f in FEATURES},
            "label": cb.ATTRIBUTE_LABEL,
            "lower_label": {f: label.lower() for f, label in cb.ATTRIBUTE_LABEL.items()},
            "kind": cb.ATTRIBUTE_KIND,
            "domain_id": {f: f"domain-{domain}" for f, domain in cb.DOMAIN_OF.items()},
            "domain_label": {f: cb.DOMAIN_LABEL[domain] for f, domain in cb.DOMAIN_OF.items()},
        },
        raw=True,
    )
    long = df.select(KEY, F.inline(entries)).withColumnsRenamed({"value": "value_text", "raw_value": "value"})
    if importance is None:
        missing = {n: F.lit(None).cast(DETAIL_FIELDS[n]) for n in ("importance_rank", "importance_mean", "importance_std")}
        long = long.withColumns(missing)
    else:
        long = with_importance(long, importance)
    return long.withColumn("direction", direction(F.col("shap_value")))


# The four nodes of a feature (slot, id prefix, type, groups).
FEATURE_NODES = [
    ("observation", "observation-", "Observation", ["profile", "explanation"]),
    ("attribute", "attribute-", "AttributeDefinition", ["profile"]),
    ("state", "state-", "State", ["profile"]),
    ("contribution", "contribution-", "ShapContribution", ["explanation"]),
]
# The other nodes of a respondent (slot, id, type, groups, label, summary).
RESPONDENT_NODES = [
    (
        "patient", PATIENT, "PatientSnapshot", ["profile"], "Current Patient",
        "Temporary patient snapshot built from the selected dataset row.",
    ),
    *[
        (
            "domain", f"domain-{key}", "Domain", ["profile", "explanation"], name,
            f"Groups current-profile observations in the {name} domain.",
        )
        for key, name in cb.DOMAINS
    ],
    ("prediction", PREDICTION, "Prediction", ["prediction", "explanation"], "", ""),
    *[(f"probability{i}", f"probability-{i}", "RiskProbability", ["prediction"], "", "") for i in cb.LABELS],
    (
        "model", MODEL, "ModelVersion", ["prediction", "explanation"], "",
        "Trained Random Forest artifact used for this prediction.",
    ),
    ("evaluation", EVALUATION, "ModelEvaluation", ["prediction"], "Model Evaluation", ""),
    (
        "twin", TWIN, "DigitalTwin", ["twin"], "Current 3D Digital Twin",
        "3D representation linked to this patient snapshot.",
    ),
]


def _feature_nodes(long: DataFrame) -> DataFrame:
    c = F.col
    laid = long.select("*", _templates(FEATURE_NODES, ["slot", "prefix", "type", "groups"])).withColumn(
        "id", F.concat("prefix", "part")
    )
    name = c("lower_label")
    label = _slot_case(
        {
            "observation": F.concat(c("label"), F.lit(": "), c("value_text")),
            "attribute": c("label"),
            "state": c("state"),
            "contribution": F.concat(c("feature"), F.lit(" SHAP "), signed_text(c("shap_value"), 3)),
        }
    )
    summary = _slot_case(
        {
            slot: filled(
                text, name=name, value=c("value_text"), feature=c("feature"), direction=c("direction")
            )
            for slot, text in cb.NODE_SUMMARIES.items()
        }
    )

    def on(column: str, *slots: str) -> Column:
        return F.when(c("slot").isin(*slots), c(column))

    details = {
        "feature": c("feature"),
        "kind": on("kind", "attribute"),
        "domain": on("domain_label", "observation", "attribute"),
        "raw_value": on("value", "observation", "state"),
        "decoded_state": on("state", "observation"),
        "rule": _slot_case({"state": F.lit(cb.STATE_RULE)}),
        "importance_rank": on("importance_rank", "observation"),
        "importance_mean": on("importance_mean", "observation"),
        "importance_std": on("importance_std", "observation"),
        "shap_value": on("shap_value", "observation", "contribution"),
        "shap_direction": on("direction", "observation", "contribution"),
        "meaning": _slot_case({"contribution": F.lit(cb.CONTRIBUTION_MEANING)}),
    }
    return laid.select(*_node_columns(label, summary, F.when(c("slot") != "attribute", c("domain_id")), details))


def _respondent_nodes(df: DataFrame) -> DataFrame:
    c = F.col
    names = ["slot", "id", "type", "groups", "fixed_label", "fixed_summary"]
    laid = df.withColumns(
        {
            "predicted_label": class_label(c("predicted_class")),
            "warning": model_warning(c("medium_recall")),
            "percent": c("high_risk_probability") * 100,
        }
    ).select("*", _templates(RESPONDENT_NODES, names))
    class_id = F.when(c("slot").startswith("probability"), F.substring("slot", 12, 1).cast("int"))
    laid = laid.withColumn("class_id", class_id).withColumn("share", F.get("probabilities", c("class_id")))
    share_label = class_label(c("class_id"))
    label = F.when(c("class_id").isNotNull(), F.concat(share_label, F.lit(": "), percent_text(c("share")))).otherwise(
        F.coalesce(
            _slot_case({"prediction": F.concat(F.lit("Prediction: "), c("predicted_label")), "model": c("model_name")}),
            c("fixed_label"),
        )
    )
    summary = F.when(
        c("class_id").isNotNull(),
        F.concat(F.lit("Model probability for "), share_label, F.lit(" is "), percent_text(c("share")), F.lit(".")),
    ).otherwise(
        F.coalesce(
            _slot_case(
                {
                    "prediction": F.concat(
                        F.lit("The model predicted "), c("predicted_label"), F.lit(" for the current patient.")
                    ),
                    "evaluation": c("warning"),
                }
            ),
            c("fixed_summary"),
        )
    )

    def on(column: Column, slot: str) -> Column:
        return F.when(c("slot") == slot, column)

    details = {
        "persistence": on(F.lit("Not stored in the reusable definitions"), "patient"),
        "feature_count": on(F.lit(len(FEATURES)), "patient"),
        "predicted_class": on(c("predicted_class"), "prediction"),
        "high_risk_probability": on(c("high_risk_probability"), "prediction"),
        "class_id": c("class_id"),
        "probability": c("share"),
        "selected": F.when(c("class_id").isNotNull(), c("class_id") == c("predicted_class")),
        "artifact": on(c("model_name"), "model"),
        **{name: on(c(name), "evaluation") for name in EVALUATION_FIELDS},
        "warning": on(c("warning"), "evaluation"),
        "bmi": on(c("BMI"), "twin"),
        "beta0": on(shape_coefficient(c("BMI")), "twin"),
        "risk_percent": on(c("percent"), "twin"),
        "risk_band": on(risk_band(c("percent")), "twin"),
        "color": on(risk_colour(c("percent")), "twin"),
    }
    return laid.select(*_node_columns(label, summary, F.lit(None), details))


def _evaluated(df: DataFrame, model_name: str, evaluation: DataFrame | None) -> DataFrame:
    named = df.withColumn("model_name", F.lit(model_name))
    if evaluation is None:
        return named.withColumns({n: F.lit(None).cast("double") for n in EVALUATION_FIELDS})
    return with_evaluation(named, evaluation)


def nodes(
    df: DataFrame, model_name: str, importance: DataFrame | None = None, evaluation: DataFrame | None = None
) -> DataFrame:
    """98 nodes per scored respondent (needs ``shap`` and ``probabilities``).

    Respondents no graph can be built for (``graph_ready``) get none.
    """
    df = graph_ready(df)[0]
    return _respondent_nodes(_evaluated(df, model_name, evaluation)).unionByName(
        _feature_nodes(feature_rows(df, importance))
    )


# Edges of a feature (slot, offset, source prefix, target prefix, relationship, label, group).
FEATURE_EDGES = [
    (1, "", "observation-", "HAS_OBSERVATION", "has observation", "profile"),
    (2, "observation-", "attribute-", "INSTANCE_OF", "instance of", "profile"),
    (3, "attribute-", "domain-", "BELONGS_TO", "belongs to", "profile"),
    (4, "observation-", "state-", "HAS_STATE", "decoded as", "profile"),
    (5, "observation-", "contribution-", "HAS_CONTRIBUTION", "has SHAP", "explanation"),
    (6, "contribution-", "", "", "", ""),
]
_N = len(FEATURES)
# The other edges of a respondent (number, source, target, relationship, label, group).
RESPONDENT_EDGES = [
    (5 * _N + 1, PATIENT, PREDICTION, "HAS_PREDICTION", "has prediction", "prediction"),
    *[(5 * _N + 2 + i, PREDICTION, f"probability-{i}", "ESTIMATES", "estimates", "prediction") for i in cb.LABELS],
    (6 * _N + 5, PREDICTION, MODEL, "GENERATED_BY", "generated by", "prediction"),
    (6 * _N + 6, MODEL, EVALUATION, "EVALUATED_BY", "evaluated by", "prediction"),
    (6 * _N + 7, TWIN, PATIENT, "REPRESENTS", "represents", "twin"),
    (6 * _N + 8, TWIN, f"observation-{slug_of('BMI')}", "SHAPED_BY", "shaped by", "twin"),
    (6 * _N + 9, TWIN, "probability-2", "COLORED_BY", "colored by", "twin"),
]


def _edge_columns(weight: Column, shap: Column) -> list[Column]:
    return [
        F.col(KEY),
        F.col("edge_number"),
        F.concat(F.lit("edge-"), F.col("edge_number").cast("string")).alias("id"),
        F.col("source"),
        F.col("target"),
        F.col("relationship"),
        F.col("label"),
        F.col("group"),
        weight.alias("weight"),
        shap.alias("shap_value"),
    ]


def edges(df: DataFrame) -> DataFrame:
    """135 edges per scored respondent, numbered in construction order.

    Numbers are arithmetic: five per feature first, then the prediction, its
    probabilities, one per contribution, and the model and twin edges.
    Respondents no graph can be built for (``graph_ready``) get none.
    """
    df = graph_ready(df)[0]
    c = F.col
    names = ["edge_number", "source", "target", "relationship", "label", "group"]
    share = F.when(
        c("relationship") == "ESTIMATES", F.get("probabilities", c("edge_number") - (5 * _N + 2))
    )
    per_respondent = df.select(KEY, "probabilities", _templates(RESPONDENT_EDGES, names)).select(
        *_edge_columns(share, F.lit(None).cast("double"))
    )
    features = ", ".join(
        f"named_struct('idx', {i}, 'part', '{slug_of(f)}', 'domain', '{cb.DOMAIN_OF[f]}', 'shap_value', get(shap, {i}))"
        for i, f in enumerate(FEATURES)
    )
    long = df.selectExpr(KEY, f"inline(array({features}))").withColumn("sign", direction(c("shap_value")))
    by_sign = c("slot") == 6
    laid = long.select("*", _templates(FEATURE_EDGES, ["slot", "from", "to", "fixed", "words", "set"])).select(
        KEY,
        F.when(by_sign, 5 * _N + 5 + c("idx")).otherwise(5 * c("idx") + c("slot")).alias("edge_number"),
        F.when(c("from") == "", PATIENT).otherwise(F.concat("from", "part")).alias("source"),
        F.when(by_sign, PREDICTION).otherwise(
            F.concat("to", F.when(c("to") == "domain-", c("domain")).otherwise(c("part")))
        ).alias("target"),
        F.when(by_sign, relationship(c("shap_value"))).otherwise(c("fixed")).alias("relationship"),
        F.when(by_sign, c("sign")).otherwise(c("words")).alias("label"),
        F.when(by_sign, c("sign")).otherwise(c("set")).alias("group"),
        F.when(by_sign, c("shap_value")).alias("shap"),
    )
    return per_respondent.unionByName(laid.select(*_edge_columns(F.abs("shap"), c("shap"))))


# --- views and checks ----------------------------------------------------------


def counts_by_type(node_table: DataFrame) -> DataFrame:
    return node_table.groupBy(KEY, "type").agg(F.count(F.lit(1)).alias("n_nodes"))


def _in_view(view: Column) -> Column:
    return (view == "all") | (F.col("id") == PATIENT) | F.array_contains("groups", view)


def visible_nodes(node_table: DataFrame, view: str) -> DataFrame:
    """Nodes of one view; the respondent's own node is part of each."""
    return node_table.filter(_in_view(F.lit(view)))


def _view_bits() -> Column:
    """One bit per view the node is visible in."""
    bits = [F.when(_in_view(F.lit(v)), 1 << i).otherwise(0) for i, v in enumerate(VIEWS)]
    return sum(bits[1:], bits[0])


def visible_edges(node_table: DataFrame, edge_table: DataFrame, view: str) -> DataFrame:
    """Edges of one view: both ends are visible.

    The ids of a respondent's graph are few, so they travel as one set and each
    table is shuffled once, on the respondent.
    """
    seen = visible_nodes(node_table, view).groupBy(KEY).agg(F.collect_set("id").alias("_seen"))
    both = F.array_contains("_seen", F.col("source")) & F.array_contains("_seen", F.col("target"))
    return edge_table.join(by_shuffle(seen), KEY).filter(both).drop("_seen")


def view_sizes(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Visible nodes and edges of every respondent in every view; without edges their number is 0."""
    marked = node_table.select(KEY, "id", _view_bits().alias("bits"))

    def per_view(bits: Column) -> list[Column]:
        return [F.count_if(F.getbit(bits, F.lit(i)) == 1) for i in range(len(VIEWS))]

    seen = marked.groupBy(KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("id", "bits"))).alias("_bits"),
        F.array(*per_view(F.col("bits"))).alias("_nodes"),
    )
    ends = F.try_element_at("_bits", F.col("source")).bitwiseAND(F.try_element_at("_bits", F.col("target")))
    shown = (
        seen.join(by_shuffle(edge_table.select(KEY, "source", "target")), KEY, "left")
        .select(KEY, "_nodes", F.coalesce(ends, F.lit(0)).alias("_shared"))
        .groupBy(KEY)
        .agg(F.any_value("_nodes").alias("_nodes"), F.array(*per_view(F.col("_shared"))).alias("_edges"))
    )
    rows = ", ".join(
        f"named_struct('view', '{v}', 'n_nodes', _nodes[{i}], 'n_edges', _edges[{i}])" for i, v in enumerate(VIEWS)
    )
    return shown.selectExpr(KEY, f"inline(array({rows}))")


def _ends(edge_table: DataFrame) -> DataFrame:
    """Every edge seen from both of its ends."""
    ends = F.array(
        F.struct(F.col("source").alias("node"), F.col("target").alias("other"), F.lit("out").alias("direction")),
        F.struct(F.col("target").alias("node"), F.col("source").alias("other"), F.lit("in").alias("direction")),
    )
    return edge_table.select("*", F.explode(ends).alias("x")).select("*", "x.*").drop("x")


def connections(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Edges of every node with direction and the label of the other end."""
    labels = node_table.groupBy(KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("id", F.col("label").alias("l")))).alias("_labels")
    )
    # label both ends first: each edge meets the labels once, then shows up twice
    labelled = (
        edge_table.select(KEY, "edge_number", "source", "target", F.col("label").alias("edge_label"))
        .join(by_shuffle(labels), KEY)
        .select(
            KEY, "edge_number", "source", "target", "edge_label",
            F.try_element_at("_labels", F.col("source")).alias("source_label"),
            F.try_element_at("_labels", F.col("target")).alias("target_label"),
        )
    )
    other_label = F.when(F.col("direction") == "out", F.col("target_label")).otherwise(F.col("source_label"))
    return _ends(labelled).select(
        KEY, "node", "edge_number", "direction", "edge_label", "other", other_label.alias("other_label")
    )


def neighbourhoods(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Closed one-hop neighbourhood of every node: itself and both directions."""
    own = node_table.select(KEY, F.col("id").alias("node"), F.col("id").alias("neighbour"))
    around = _ends(edge_table.select(KEY, "source", "target")).select(KEY, "node", F.col("other").alias("neighbour"))
    return own.unionByName(around).distinct()


def faded_nodes(node_table: DataFrame, edge_table: DataFrame, focus: str) -> DataFrame:
    """All nodes outside the neighbourhood of the focused node of each respondent."""
    touching = edge_table.filter((F.col("source") == focus) | (F.col("target") == focus))
    near = touching.groupBy(KEY).agg(
        F.array_union(F.collect_set("source"), F.collect_set("target")).alias("_near")
    )
    inside = F.coalesce(F.array_contains("_near", F.col("id")), F.lit(False)) | (F.col("id") == focus)
    return node_table.join(by_shuffle(near), KEY, "left").filter(~inside).drop("_near")


def dangling_edges(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Edges with an end that is no node of the same respondent."""
    known = node_table.groupBy(KEY).agg(F.collect_set("id").alias("_ids"))
    both = F.array_contains("_ids", F.col("source")) & F.array_contains("_ids", F.col("target"))
    return edge_table.join(by_shuffle(known), KEY, "left").filter(~F.coalesce(both, F.lit(False))).drop("_ids")
