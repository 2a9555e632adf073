"""The graph, catalog and evidence queries in plain SQL."""

from __future__ import annotations

from vitalgrid.plans.model_oracles import _BAND, _COLOUR, _IMPORTANCE, _NEW_TWINS, _OLD_TWINS, _EDITED_SCORED, _PER_CLASS
from vitalgrid.plans.sql_base import LABEL, with_tables
from vitalgrid.plans.survey_oracles import DECODED, DEFINITIONS, LONG, VALUE_MEANINGS

_SIGN = "CASE WHEN shap > 0 THEN 'supports' WHEN shap < 0 THEN 'opposes' ELSE 'neutral' END"
_SLUG = "lower(feature)"
_BASE = f"""
{LONG}, meanings AS ({VALUE_MEANINGS}), decoded AS ({DECODED}), definitions AS ({DEFINITIONS}), {_IMPORTANCE}, {_PER_CLASS},
facts AS (SELECT d.rid + 1 AS patient_number, d.idx, d.feature, d.value, d.value_text, d.state, s.shap, {_SIGN} AS sign,
    a.label, a.kind, a.domain, a.domain_label, i.importance_rank
    FROM decoded d JOIN shap s ON s.rid = d.rid AND s.idx = d.idx JOIN definitions a ON a.feature = d.feature
    JOIN importance i ON i.feature = d.feature),
model AS (SELECT sum(tp) * 1e0 / any_value(n) AS accuracy, max(rec) FILTER (WHERE c = 1) AS medium, max(rec) FILTER (WHERE c = 2) AS high
    FROM figures),
warning AS (SELECT CASE WHEN medium < 0.1 THEN concat('Model limitation: Medium (prediabetes) recall is ', format('{{:.2f}}', medium * 100),
    '% in the checked test metrics. Do not interpret this prototype as a clinical screening system.')
    ELSE 'Model results are research outputs, not clinical diagnoses.' END AS w FROM model),
people AS (SELECT s.rid + 1 AS patient_number, s.*, v.BMI, {LABEL.format(c='s.cls')} AS cls_label FROM scored s JOIN survey v ON v.rid = s.rid),
probs AS (SELECT patient_number, 0 AS c, p0 AS p, cls FROM people UNION ALL SELECT patient_number, 1, p1, cls FROM people
    UNION ALL SELECT patient_number, 2, p2, cls FROM people)
"""
_NODES = f"""
nodes AS (
SELECT patient_number, 'patient-current' AS id, 'Current Patient' AS label, 'PatientSnapshot' AS type, 'profile' AS groups,
    'Temporary patient snapshot built from the selected dataset row.' AS summary, CAST(NULL AS VARCHAR) AS parent FROM people
UNION ALL SELECT patient_number, concat('domain-', k), l, 'Domain', 'profile,explanation',
    concat('Groups current-profile observations in the ', l, ' domain.'), NULL
    FROM people CROSS JOIN (SELECT DISTINCT domain AS k, domain_label AS l FROM definitions) d
UNION ALL SELECT patient_number, concat('observation-', {_SLUG}), concat(label, ': ', value_text), 'Observation', 'profile,explanation',
    concat('Current ', lower(label), ' value is ', value_text, '.'), concat('domain-', domain) FROM facts
UNION ALL SELECT patient_number, concat('attribute-', {_SLUG}), label, 'AttributeDefinition', 'profile',
    concat('Reusable definition for the ', feature, ' model input.'), NULL FROM facts
UNION ALL SELECT patient_number, concat('state-', {_SLUG}), state, 'State', 'profile',
    concat('Dataset-defined meaning of ', lower(label), ' value ', value_text, '.'), concat('domain-', domain) FROM facts
UNION ALL SELECT patient_number, concat('contribution-', {_SLUG}), concat(feature, ' SHAP ', format('{{:+.3f}}', shap)), 'ShapContribution',
    'explanation', concat(feature, ' ', sign, ' the predicted class in this model output.'), concat('domain-', domain) FROM facts
UNION ALL SELECT patient_number, 'prediction-current', concat('Prediction: ', cls_label), 'Prediction', 'prediction,explanation',
    concat('The model predicted ', cls_label, ' for the current patient.'), NULL FROM people
UNION ALL SELECT patient_number, concat('probability-', c), concat({LABEL.format(c='c')}, ': ', format('{{:.1f}}', p * 100), '%'),
    'RiskProbability', 'prediction', concat('Model probability for ', {LABEL.format(c='c')}, ' is ', format('{{:.1f}}', p * 100), '%.'), NULL FROM probs
UNION ALL SELECT patient_number, 'model-current', 'demo-forest', 'ModelVersion', 'prediction,explanation',
    'Trained Random Forest artifact used for this prediction.', NULL FROM people
UNION ALL SELECT patient_number, 'model-evaluation', 'Model Evaluation', 'ModelEvaluation', 'prediction', w, NULL FROM people CROSS JOIN warning
UNION ALL SELECT patient_number, 'digital-twin-current', 'Current 3D Digital Twin', 'DigitalTwin', 'twin',
    '3D representation linked to this patient snapshot.', NULL FROM people)
"""
_OBS, _ATT, _STA, _CON = (f"concat('{p}-', {_SLUG})" for p in ("observation", "attribute", "state", "contribution"))
_EDGES = f"""
edges AS (
SELECT patient_number, 5 * idx + 1 AS edge_number, 'patient-current' AS source, {_OBS} AS target, 'HAS_OBSERVATION' AS relationship,
    'has observation' AS label, 'profile' AS grp, CAST(NULL AS DOUBLE) AS weight, CAST(NULL AS DOUBLE) AS shap FROM facts
UNION ALL SELECT patient_number, 5 * idx + 2, {_OBS}, {_ATT}, 'INSTANCE_OF', 'instance of', 'profile', NULL, NULL FROM facts
UNION ALL SELECT patient_number, 5 * idx + 3, {_ATT}, concat('domain-', domain), 'BELONGS_TO', 'belongs to', 'profile', NULL, NULL FROM facts
UNION ALL SELECT patient_number, 5 * idx + 4, {_OBS}, {_STA}, 'HAS_STATE', 'decoded as', 'profile', NULL, NULL FROM facts
UNION ALL SELECT patient_number, 5 * idx + 5, {_OBS}, {_CON}, 'HAS_CONTRIBUTION', 'has SHAP', 'explanation', NULL, NULL FROM facts
UNION ALL SELECT patient_number, 106, 'patient-current', 'prediction-current', 'HAS_PREDICTION', 'has prediction', 'prediction', NULL, NULL FROM people
UNION ALL SELECT patient_number, 107 + c, 'prediction-current', concat('probability-', c), 'ESTIMATES', 'estimates', 'prediction', p, NULL FROM probs
UNION ALL SELECT patient_number, 110 + idx, {_CON}, 'prediction-current',
    CASE WHEN shap > 0 THEN 'SUPPORTS_PREDICTION' WHEN shap < 0 THEN 'OPPOSES_PREDICTION' ELSE 'NEUTRAL_FOR_PREDICTION' END,
    sign, sign, abs(shap), shap FROM facts
UNION ALL SELECT patient_number, 131, 'prediction-current', 'model-current', 'GENERATED_BY', 'generated by', 'prediction', NULL, NULL FROM people
UNION ALL SELECT patient_number, 132, 'model-current', 'model-evaluation', 'EVALUATED_BY', 'evaluated by', 'prediction', NULL, NULL FROM people
UNION ALL SELECT patient_number, 133, 'digital-twin-current', 'patient-current', 'REPRESENTS', 'represents', 'twin', NULL, NULL FROM people
UNION ALL SELECT patient_number, 134, 'digital-twin-current', 'observation-bmi', 'SHAPED_BY', 'shaped by', 'twin', NULL, NULL FROM people
UNION ALL SELECT patient_number, 135, 'digital-twin-current', 'probability-2', 'COLORED_BY', 'colored by', 'twin', NULL, NULL FROM people)
"""
_SEES = "(g.view = 'all' OR n.id = 'patient-current' OR contains(concat(',', n.groups, ','), concat(',', g.view, ',')))"
_VIEWS = f"""
views AS (SELECT * FROM (VALUES ('all'), ('profile'), ('explanation'), ('prediction'), ('twin')) AS g(view)),
seen AS (SELECT g.view, n.patient_number, n.id FROM nodes n CROSS JOIN views g WHERE {_SEES}),
shown AS (SELECT a.view, e.patient_number, e.edge_number, e.source, e.target, e.relationship FROM edges e
    JOIN seen a ON a.patient_number = e.patient_number AND a.id = e.source
    JOIN seen b ON b.view = a.view AND b.patient_number = e.patient_number AND b.id = e.target)
"""


def _graph(body: str, *parts: str, shap: str = "shap") -> str:
    base = _BASE.strip().replace("JOIN shap s ", f"JOIN {shap} s ")
    return with_tables("WITH " + ",".join([base, *[p.strip() for p in parts]]) + body, "survey", "scored", shap)


def _explanation_edges(shap: str) -> str:
    counts = " SELECT source, target, relationship, count(*) AS n_edges FROM shown WHERE view = 'explanation' GROUP BY ALL"
    return _graph(counts, _NODES, _EDGES, _VIEWS, shap=shap)


_SAFE = " This research note is non-causal. Medium recall is 0.0. It is not medical advice."
_FLAT = "regexp_replace(coalesce(text, ''), '[\\n\\r]+', ' ', 'g')"
_DRAFTS = f"""
drafts AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN concat({_FLAT}, '{_SAFE}')
    WHEN 2 THEN concat({_FLAT}, '{_SAFE}', chr(10), '- a bullet') WHEN 3 THEN concat(' ', chr(10), chr(9), ' ')
    WHEN 4 THEN concat({_FLAT}, '{_SAFE} Walking REDUCES THE RISK.')
    ELSE concat('  ', coalesce(text, ''), '{_SAFE}') END AS draft FROM documents)
"""
# Prohibited wordings, in list order.
_CLAIMS = [
    "causes diabetes", "prevent diabetes", "protective effect", "reduces the risk", "reduce the risk", "increases the risk",
    "increase the risk", "risk of developing diabetes", "chances of diabetes", "strong predictor",
    "contribute to an increased likelihood",
]
_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _markup(d: str) -> str:
    return rf"regexp_matches({d}, '(?m)^{_SPACE}*(?:#{{1,6}}{_SPACE}|[-*]{_SPACE}|\p{{Nd}}+\.{_SPACE})')"



def _has(d: str, *phrases: str) -> str:
    return "(" + " OR ".join(f"contains(lower({d}), '{p}')" for p in phrases) + ")"


def _flags(d: str) -> dict[str, str]:
    return {
        "has_research": _has(d, "research"),
        "has_not_advice": _has(d, "not medical advice"),
        "has_zero_recall": _has(d, "0.0"),
        "names_medium_class": _has(d, "medium", "prediabetes"),
        "has_non_causal": _has(d, "non-causal", "not a cause", "does not mean"),
    }


def _passes(d: str) -> str:
    return " AND ".join([*_flags(d).values(), f"NOT {_has(d, *_CLAIMS)}", f"NOT {_markup(d)}"])


_STRIPPED = f"regexp_replace(regexp_replace(draft, '^{_SPACE}+', ''), '{_SPACE}+$', '')"
_DESCRIBED = "concat(label, ' (', state, ', SHAP ', format('{:+.3f}', shap), ')')"
# The sentences of the summary around its figures.
_SUMMARY = f"""
up AS (SELECT *, row_number() OVER (PARTITION BY patient_number ORDER BY shap DESC, idx) AS place FROM facts WHERE shap > 0),
down AS (SELECT *, row_number() OVER (PARTITION BY patient_number ORDER BY shap, idx DESC) AS place FROM facts WHERE shap < 0),
up_text AS (SELECT patient_number, string_agg({_DESCRIBED}, '; ' ORDER BY place) AS t FROM up WHERE place <= 3 GROUP BY 1),
down_text AS (SELECT patient_number, string_agg({_DESCRIBED}, '; ' ORDER BY place) AS t FROM down WHERE place <= 2 GROUP BY 1),
summaries AS (SELECT p.patient_number, concat('evidence summary is shown instead. For Patient #', p.patient_number,
    ', the research model predicted ', cls_label, '. Its estimated probabilities were Low ', format('{{:.1f}}', p0 * 100),
    '%, Medium (prediabetes) ', format('{{:.1f}}', p1 * 100), '%, High (diabetes) ', format('{{:.1f}}', p2 * 100),
    '%. These are model estimates, not a diagnosis.', chr(10), chr(10), 'The largest positive SHAP contributions were ',
    coalesce(u.t, 'no factors'), '. The largest negative SHAP contributions were ', coalesce(d.t, 'no factors'),
    '. Positive and negative SHAP values describe support for or opposition to this model output; they do not mean that a feature caused or prevented diabetes.',
    chr(10), chr(10), 'A qualified healthcare professional can help interpret the recorded survey observations in their full context. Do not use this prototype to start, stop, or change medication or treatment. ',
    'Model limitation: Medium (prediabetes) recall is 0.00% in the checked test metrics. Do not interpret this prototype as a clinical screening system.',
    ' This summary is model-based, non-causal, for research only, and not medical advice.') AS body
    FROM people p LEFT JOIN up_text u ON u.patient_number = p.patient_number LEFT JOIN down_text d ON d.patient_number = p.patient_number)
"""
_REPLACED = "'The local model draft did not pass the research-safety checks, so this deterministic '"
_HOSTED = "'This hosted deployment uses a deterministic, safety-checked '"

ORACLES = {
    "graph_nodes": _graph(
        " SELECT id, label, type, groups, summary, parent, count(*) AS n_nodes, CAST(sum(patient_number) AS BIGINT) AS number_sum "
        "FROM nodes GROUP BY ALL",
        _NODES,
    ),
    "graph_node_details": _graph(
        f"""
,
detail AS (SELECT concat('observation-', {_SLUG}) AS id, 'Observation' AS type, value AS raw, shap, sign, importance_rank AS irank, NULL AS cls, NULL::DOUBLE AS p,
      FALSE AS sel, NULL::DOUBLE AS acc, NULL::DOUBLE AS hr, NULL::DOUBLE AS b0, NULL AS band, NULL AS colour, state AS st, domain_label AS dom, NULL AS kind FROM facts
  UNION ALL SELECT concat('attribute-', {_SLUG}), 'AttributeDefinition', NULL, NULL, NULL, NULL, NULL, NULL, FALSE, NULL, NULL, NULL, NULL, NULL, NULL, domain_label, kind FROM facts
  UNION ALL SELECT concat('state-', {_SLUG}), 'State', value, NULL, NULL, NULL, NULL, NULL, FALSE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM facts
  UNION ALL SELECT concat('contribution-', {_SLUG}), 'ShapContribution', NULL, shap, sign, NULL, NULL, NULL, FALSE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM facts
  UNION ALL SELECT 'patient-current', 'PatientSnapshot', NULL, NULL, NULL, NULL, NULL, NULL, FALSE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM people
  UNION ALL SELECT concat('domain-', k), 'Domain', NULL, NULL, NULL, NULL, NULL, NULL, FALSE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT domain AS k FROM definitions) d
  UNION ALL SELECT 'prediction-current', 'Prediction', NULL, NULL, NULL, NULL, cls, NULL, FALSE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM people
  UNION ALL SELECT concat('probability-', c), 'RiskProbability', NULL, NULL, NULL, NULL, NULL, p, c = cls, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM probs
  UNION ALL SELECT 'model-current', 'ModelVersion', NULL, NULL, NULL, NULL, NULL, NULL, FALSE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM model
  UNION ALL SELECT 'model-evaluation', 'ModelEvaluation', NULL, NULL, NULL, NULL, NULL, NULL, FALSE, accuracy, high, NULL, NULL, NULL, NULL, NULL, NULL FROM model
  UNION ALL SELECT 'digital-twin-current', 'DigitalTwin', NULL, NULL, NULL, NULL, NULL, NULL, FALSE, NULL, NULL, (BMI - 22) * 0.5e0, {_BAND.format(p='p2 * 100')},
      {_COLOUR.format(p='p2 * 100')}, NULL, NULL, NULL FROM people)
SELECT id, type, sum(raw) AS raw_value_sum, sum(shap) AS shap_sum, count(*) FILTER (WHERE sign = 'supports') AS n_supports,
    count(*) FILTER (WHERE sign = 'opposes') AS n_opposes, CAST(max(irank) AS INTEGER) AS importance_rank, CAST(sum(cls) AS BIGINT) AS class_sum,
    sum(p) AS probability_sum, count(*) FILTER (WHERE sel) AS n_selected, round(max(acc), 9) AS accuracy, round(max(hr), 9) AS high_recall,
    sum(b0) AS beta0_sum, count(*) FILTER (WHERE band = 'Moderate') AS n_moderate, count(*) FILTER (WHERE colour = '#2ECC71') AS n_green,
    max(st) AS last_state, max(dom) AS domain, max(kind) AS kind FROM detail GROUP BY id, type
"""
    ),
    "graph_edges": _graph(
        " SELECT CAST(edge_number AS INTEGER) AS edge_number, concat('edge-', edge_number) AS id, source, target, relationship, label, grp AS \"group\", "
        "count(*) AS n_edges, CAST(sum(patient_number) AS BIGINT) AS number_sum, sum(weight) AS weight_sum, sum(shap) AS shap_sum "
        "FROM edges GROUP BY ALL",
        _EDGES,
    ),
    "graph_counts": _graph(" SELECT patient_number, type, count(*) AS n_nodes FROM nodes GROUP BY ALL", _NODES),
    "graph_relationships": _graph(
        " SELECT patient_number, count(*) AS n_edges, string_agg(DISTINCT relationship, ',' ORDER BY relationship) AS relationships "
        "FROM edges GROUP BY 1",
        _EDGES,
    ),
    "graph_views": _graph(
        """
, node_counts AS (SELECT view, patient_number, count(*) AS n_nodes FROM seen GROUP BY ALL),
edge_counts AS (SELECT view, patient_number, count(*) AS n_edges FROM shown GROUP BY ALL)
SELECT n.patient_number, n.view, n.n_nodes, coalesce(e.n_edges, 0) AS n_edges FROM node_counts n
LEFT JOIN edge_counts e ON e.view = n.view AND e.patient_number = n.patient_number
""",
        _NODES,
        _EDGES,
        _VIEWS,
    ),
    "explanation_view": " UNION ALL ".join(f"SELECT '{name}' AS explained_by, * FROM ({_explanation_edges(shap)}) e" for name, shap in (("forest", "shap"), ("made", "made_shap"))),
    "graph_connections": _graph(
        """
, ends AS (SELECT patient_number, source AS node, 'out' AS direction, label, target AS other FROM edges
    UNION ALL SELECT patient_number, target, 'in', label, source FROM edges)
SELECT e.node, e.direction, e.label AS edge_label, e.other, n.label AS other_label, count(*) AS n_rows,
    CAST(sum(e.patient_number) AS BIGINT) AS number_sum
FROM ends e LEFT JOIN nodes n ON n.patient_number = e.patient_number AND n.id = e.other GROUP BY ALL
""",
        _NODES,
        _EDGES,
    ),
    "graph_neighbourhoods": _graph(
        """
, around AS (SELECT patient_number, id AS node, id AS neighbour FROM nodes UNION SELECT patient_number, source, target FROM edges
    UNION SELECT patient_number, target, source FROM edges)
SELECT node, neighbour, count(*) AS n_rows FROM around GROUP BY ALL
""",
        _NODES,
        _EDGES,
    ),
    "faded_nodes": _graph(
        """
, near AS (SELECT patient_number, target AS id FROM edges WHERE source = 'prediction-current'
    UNION SELECT patient_number, source FROM edges WHERE target = 'prediction-current')
SELECT n.id, n.type, count(*) AS n_nodes FROM nodes n LEFT JOIN near x ON x.patient_number = n.patient_number AND x.id = n.id
WHERE x.id IS NULL AND n.id <> 'prediction-current' GROUP BY ALL
""",
        _NODES,
        _EDGES,
    ),
    "dangling_edges": _graph(
        " SELECT e.patient_number, concat('edge-', e.edge_number) AS id, e.relationship, e.target FROM edges e "
        "JOIN people p ON p.patient_number = e.patient_number WHERE e.target = 'probability-2' AND p.p2 < 0.3",
        _EDGES,
    ),
    "detach_delete": _graph(
        """
, doomed AS (SELECT patient_number, id FROM nodes WHERE type = 'State' AND label = 'Obesity')
SELECT type AS what, count(*) AS n_rows FROM nodes WHERE NOT (type = 'State' AND label = 'Obesity') GROUP BY 1
UNION ALL SELECT relationship, count(*) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM doomed d WHERE d.patient_number = e.patient_number
    AND d.id IN (e.source, e.target)) GROUP BY 1
""",
        _NODES,
        _EDGES,
    ),
    "graph_quarantine": """
SELECT o_orderkey + 1 AS patient_number, CASE WHEN o_orderkey % 13 = 5 THEN 'Income' ELSE '' END AS missing_shap,
    CASE WHEN o_orderkey % 11 = 3 THEN 'Age' ELSE '' END AS undecodable
FROM orders WHERE o_orderkey % 13 = 5 OR o_orderkey % 11 = 3
""",
    "gated_edges": """
SELECT o_orderkey + 1 AS patient_number, 135::BIGINT AS n_edges FROM orders WHERE o_orderkey % 13 <> 5 AND o_orderkey % 11 <> 3
""",
    "unexplained_summaries": """
SELECT o_orderkey + 1 AS patient_number, 'Age' AS undecodable FROM orders WHERE o_orderkey % 11 = 3
""",
    "trained_to_graph": with_tables(
        "SELECT rid + 1 AS patient_number, true AS adds_up, 98 AS n_nodes, 135 AS n_edges FROM survey", "survey"
    ),
    "catalog_versions": with_tables(
        f"""
WITH meanings AS ({VALUE_MEANINGS}), definitions AS ({DEFINITIONS}),
used AS (SELECT count(DISTINCT CASE WHEN BMI < 18.5 THEN 1 WHEN BMI < 25 THEN 2 WHEN BMI < 30 THEN 3 ELSE 4 END) AS k FROM survey),
held AS (SELECT 'Domain' AS what, count(DISTINCT domain) AS n_rows, 0 AS first FROM definitions
    UNION ALL SELECT 'AttributeDefinition', count(*), 0 FROM definitions UNION ALL SELECT 'BELONGS_TO', count(*), 0 FROM definitions
    UNION ALL SELECT w, n, 0 FROM (VALUES ('CategoryDefinition', 4), ('CLASSIFIED_AS', 4), ('ModelVersion', 1), ('ModelEvaluation', 1), ('EVALUATED_BY', 1)) AS c(w, n)
    UNION ALL SELECT 'ValueDefinition', count(*), 1 FROM meanings UNION ALL SELECT 'DECODES_TO', count(*), 1 FROM meanings),
every AS (SELECT version, what, n_rows FROM held CROSS JOIN (VALUES (0), (1), (2)) AS v(version) WHERE version >= first
    UNION ALL SELECT 0, 'BmiCategory', k FROM used UNION ALL SELECT version, 'HealthConcept', CASE version WHEN 0 THEN 2 * k ELSE k END
        FROM used CROSS JOIN (VALUES (0), (1), (2)) AS v(version)
    UNION ALL SELECT version, 'ABOUT', CASE version WHEN 0 THEN 2 * k ELSE k END FROM used CROSS JOIN (VALUES (0), (1), (2)) AS v(version))
SELECT version::BIGINT AS version, what, n_rows::BIGINT AS n_rows, version < 2 AS changed FROM every
""",
        "survey",
        "features",
    ),
    "catalog_usage": with_tables(
        f"""
WITH {LONG}, meanings AS ({VALUE_MEANINGS}), definitions AS ({DEFINITIONS}),
sizes AS (SELECT l, lo, hi, k, (SELECT count(*) FROM survey WHERE BMI >= lo AND (hi IS NULL OR BMI < hi)) AS n
    FROM (VALUES ('Underweight', 0e0, 18.5e0, 5), ('Healthy range', 18.5e0, 25e0, 5), ('Overweight', 25e0, 30e0, 5), ('Obesity', 30e0, NULL, 4)) AS r(l, lo, hi, k))
SELECT 'Domain' AS node_label, domain AS node_key, CAST(NULL AS VARCHAR) AS label, 1 AS n_properties, 'BELONGS_TO' AS linked_by,
    count(*) AS n_links, 0::BIGINT AS n_rows FROM definitions GROUP BY domain
UNION ALL SELECT 'AttributeDefinition', feature, label, 3, NULL, 0, 0 FROM definitions
UNION ALL SELECT 'ValueDefinition', concat(m.feature, ':', m.code), m.label, 2, 'DECODES_TO', 1, count(l.rid)
    FROM meanings m LEFT JOIN long l ON l.feature = m.feature AND l.value = m.code GROUP BY m.feature, m.code, m.label
UNION ALL SELECT 'CategoryDefinition', concat('BMI:', l), l, k, 'CLASSIFIED_AS', 1, n FROM sizes
UNION ALL SELECT 'ModelVersion', 'demo-forest', NULL, 0, NULL, 0, 0
UNION ALL SELECT 'ModelEvaluation', 'demo-forest:evaluation', NULL, 2, 'EVALUATED_BY', 1, 0
""",
        "survey",
    ),
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "twin_upsert": with_tables(
        f"""
WITH {_EDITED_SCORED}, {_OLD_TWINS}, {_NEW_TWINS}
SELECT o.patient_number, CASE WHEN n.risk_percent < o.risk_percent THEN n.bmi ELSE o.bmi END AS bmi, o.gender,
    least(n.risk_percent, o.risk_percent) AS risk_percent, CASE WHEN n.risk_percent < o.risk_percent THEN n.risk_band END AS risk_band
FROM old_twins o JOIN new_twins n ON n.patient_number = o.patient_number
""",
        "scored",
    ),
    "property_merge": with_tables(
        """
SELECT rid, 'age' AS property, CAST(CAST(Age AS INTEGER) AS VARCHAR) AS value FROM survey
UNION ALL SELECT rid, 'sex', CAST(CAST(Sex AS INTEGER) AS VARCHAR) FROM survey WHERE Smoker = 1
UNION ALL SELECT rid, 'bmi', CAST(CAST(trunc(CASE WHEN Smoker = 1 THEN BMI + 1 ELSE BMI END) AS INTEGER) AS VARCHAR) FROM survey
    WHERE NOT (Smoker = 1 AND BMI < 20)
""",
        "survey",
    ),
    "evidence_packages": _graph(
        f"""
SELECT f.patient_number, concat('Patient #', f.patient_number) AS reference, any_value(p.cls_label) AS label,
    'Low,Medium (prediabetes),High (diabetes)' AS classes, CAST(count(*) AS INTEGER) AS n_attributes,
    string_agg(concat(f.feature, '=', f.value_text), ';' ORDER BY f.idx) AS "values", string_agg(f.state, ';' ORDER BY f.idx) AS states,
    sum(f.shap) AS shap_sum, any_value({_BAND.format(p='p.p2 * 100')}) AS risk_band,
    'Model results are research outputs, not clinical diagnoses.' AS model_limitation,
    'BRFSS observations and SHAP values are model-based associations, not clinical causes.' AS evidence_boundary
FROM facts f JOIN people p ON p.patient_number = f.patient_number GROUP BY f.patient_number
"""
    ),
    "incomplete_evidence": with_tables(
        "SELECT rid + 1 AS patient_number, CAST(count(*) FILTER (WHERE shap <> 0) AS INTEGER) AS n_attributes FROM shap "
        "GROUP BY 1 HAVING count(*) FILTER (WHERE shap <> 0) < 21",
        "shap",
    ),
    "evidence_summaries": _graph(
        f" SELECT patient_number, concat({_REPLACED}, body) AS summary, CAST(length(concat({_HOSTED}, body)) AS INTEGER) AS hosted_length "
        "FROM summaries",
        _SUMMARY,
    ),
    "draft_checks": f"WITH {_DRAFTS.strip()} SELECT doc_id, "
    + ", ".join(f"{sql} AS {name}" for name, sql in _flags("draft").items())
    + ", concat_ws(',', "
    + ", ".join(f"CASE WHEN contains(lower(draft), '{c}') THEN '{c}' END" for c in _CLAIMS)
    + f") AS claims, {_has('draft', *_CLAIMS)} AS makes_claim, {_markup('draft')} AS has_markup, ({_passes('draft')}) AS passes FROM drafts",
    "guidance": _graph(
        f"""
, trimmed AS (SELECT doc_id, {_STRIPPED} AS t FROM drafts),
judged_drafts AS (SELECT doc_id, t, CASE WHEN t = '' THEN 'empty' WHEN {_passes('t')} THEN 'kept' ELSE 'replaced' END AS outcome FROM trimmed)
SELECT j.doc_id, CASE WHEN s.patient_number IS NULL THEN 'no respondent' ELSE j.outcome END AS outcome,
    CASE WHEN s.patient_number IS NULL THEN NULL WHEN j.outcome = 'kept' THEN j.t WHEN j.outcome = 'replaced' THEN concat({_REPLACED}, s.body) END AS guidance
FROM judged_drafts j LEFT JOIN summaries s ON s.patient_number = j.doc_id + 1 AND j.doc_id % 3 <> 2
""",
        _SUMMARY,
        _DRAFTS,
    ),
}
ORACLES["stored_connections"] = ORACLES["graph_connections"]
ORACLES["evidence_documents"] = ORACLES["evidence_packages"]
