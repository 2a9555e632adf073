"""The model queries in plain SQL."""

from __future__ import annotations

import math

from vitalgrid.plans.sql_base import COLUMNS, CONTRIBUTIONS, LABEL, scored, with_tables
from vitalgrid.plans.survey_oracles import DEFINITIONS, LONG, SPLIT

CLASSES = (0, 1, 2)
_LABELLED = (
    "judged AS (SELECT s.rid, CAST(v.Diabetes_012 AS INTEGER) AS actual, s.cls, s.p0, s.p1, s.p2 "
    "FROM scored s JOIN survey v ON s.rid = v.rid)"
)
_PER_CLASS = f"""
{_LABELLED},
classes AS (SELECT * FROM (VALUES (0), (1), (2)) AS k(c)),
per_class AS (SELECT c, count(*) FILTER (WHERE actual = c AND cls = c) AS tp, count(*) FILTER (WHERE actual = c) AS supp,
    count(*) FILTER (WHERE cls = c) AS pred, count(*) AS n FROM judged CROSS JOIN classes GROUP BY c),
figures AS (SELECT *, CASE WHEN pred = 0 THEN 0e0 ELSE tp * 1e0 / pred END AS prec,
    CASE WHEN supp = 0 THEN 0e0 ELSE tp * 1e0 / supp END AS rec,
    CASE WHEN pred + supp = 0 THEN 0e0 ELSE 2e0 * tp / (pred + supp) END AS f1 FROM per_class)
"""
_CURVE = f"""
{_LABELLED},
points AS (SELECT 0 AS class_id, p0 AS score, actual = 0 AS pos FROM judged UNION ALL SELECT 1, p1, actual = 1 FROM judged
    UNION ALL SELECT 2, p2, actual = 2 FROM judged),
counts AS (SELECT class_id, score, count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg
    FROM points GROUP BY 1, 2),
cumulated AS (SELECT *, sum(n_pos) OVER w AS tp, sum(n_neg) OVER w AS fp, sum(n_pos) OVER (PARTITION BY class_id) AS p_all,
    sum(n_neg) OVER (PARTITION BY class_id) AS n_all FROM counts WINDOW w AS (PARTITION BY class_id ORDER BY score DESC))
"""
_AUC = """SELECT class_id, CAST(p_all AS BIGINT) AS p_all, CAST(n_all AS BIGINT) AS n_all,
    CAST(sum(n_pos * (2 * (n_all - fp) + n_neg)) AS DOUBLE) / (CAST(p_all AS DOUBLE) * CAST(n_all AS DOUBLE) * 2e0) AS auc
    FROM cumulated GROUP BY class_id, p_all, n_all"""


def _permutation(rows: str) -> str:
    """Importance SQL over ``rows`` (survey columns): rank against rank, one donor per repeat."""
    swapped = ", ".join(
        f"CASE WHEN f.feature = '{c}' THEN d.{c} ELSE b.{c} END AS {c}"
        for c in ("HighBP", "HighChol", "BMI", "GenHlth", "Age")
    )
    macro = """(SELECT sum(CASE WHEN a + p > 0 THEN 2e0 * t / (a + p) ELSE 0e0 END) / count(*) FILTER (WHERE a + p > 0)
        FROM (SELECT k.c, count(*) FILTER (WHERE x.actual = k.c AND x.cls = k.c) AS t, count(*) FILTER (WHERE x.actual = k.c) AS a,
              count(*) FILTER (WHERE x.cls = k.c) AS p FROM {x} x CROSS JOIN (VALUES (0), (1), (2)) AS k(c) GROUP BY k.c) y)"""
    return f"""
chosen AS (SELECT rid, Diabetes_012, HighBP, HighChol, BMI, GenHlth, Age FROM ({rows}) rows_in),
base AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42:base:', rid)), rid) - 1 AS place, count(*) OVER () AS n FROM chosen),
turns AS (SELECT rep, list(CAST('0x' || substr(md5(concat('42:', rep, ':', k)), 1, 8) AS BIGINT) >> 1 ORDER BY k) AS keys
    FROM (VALUES (0), (1), (2)) AS r(rep) CROSS JOIN range(24) AS t(k) GROUP BY rep),
asking AS (SELECT b.*, rep, list_reduce(list_prepend(place, keys), lambda p, k: CASE WHEN
    ((greatest(p, ((k - p) % n + n) % n) + k) % 2147483648) * 1103515245 // 32768 % 2 = 1 THEN ((k - p) % n + n) % n ELSE p END) AS donor
    FROM base b CROSS JOIN turns),
swapped AS (SELECT concat(b.rid, '/', b.rep, '/', f.feature) AS id, b.Diabetes_012 AS actual, b.rep, f.feature, {swapped}
    FROM asking b JOIN base d ON d.place = b.donor CROSS JOIN features f),
swapped_scored AS ({scored('swapped', 'id')}),
outcome AS (SELECT s.rep, s.feature, s.actual, c.cls FROM swapped s JOIN swapped_scored c ON s.id = c.id),
cells AS (SELECT rep, feature, k.c, count(*) FILTER (WHERE actual = k.c AND cls = k.c) AS t,
    count(*) FILTER (WHERE actual = k.c) AS a, count(*) FILTER (WHERE cls = k.c) AS p
    FROM outcome CROSS JOIN (VALUES (0), (1), (2)) AS k(c) GROUP BY rep, feature, k.c),
after AS (SELECT rep, feature, sum(CASE WHEN a + p > 0 THEN 2e0 * t / (a + p) ELSE 0e0 END)
    / count(*) FILTER (WHERE a + p > 0) AS macro FROM cells GROUP BY rep, feature),
base_scored AS ({scored('chosen')}),
base_outcome AS (SELECT c.Diabetes_012 AS actual, s.cls FROM chosen c JOIN base_scored s ON c.rid = s.rid)
SELECT feature, round(avg(b.v - macro), 9) AS importance_mean, round(stddev_pop(b.v - macro), 9) AS importance_std
FROM after CROSS JOIN (SELECT {macro.format(x='base_outcome')} AS v) b GROUP BY feature
"""


_SHAP = f"""
WITH totals AS ({CONTRIBUTIONS})
SELECT s.rid, s.cls AS predicted_class, f.feature, round(coalesce(t.phi, 0e0), 11) AS shap_value
FROM scored s CROSS JOIN features f LEFT JOIN totals t ON t.rid = s.rid AND t.feature = f.feature
"""


def _rest(*others: int) -> str:
    """Shapley weighted sum over all subsets of three other features that are met (o) or not (z)."""
    a, b, c = others
    return (
        f"((z{a} * z{b} * z{c} + o{a} * o{b} * o{c}) / 4e0 + (o{a} * z{b} * z{c} + z{a} * o{b} * z{c} + z{a} * z{b} * o{c}"
        f" + o{a} * o{b} * z{c} + o{a} * z{b} * o{c} + z{a} * o{b} * o{c}) / 12e0)"
    )


# the forest over all features by its rule: splits, leaves, covers, merged paths; a path has four features at most,
# and one that is not there counts as met with a share of one, which changes nothing
_WIDE = f"""
WITH {LONG},
splits AS (SELECT tree, node, feature, CASE feature WHEN 'BMI' THEN 22.25e0 + 3 * ((tree + node) % 7) WHEN 'MentHlth' THEN 2.5e0 + 4 * ((tree + node) % 5)
    WHEN 'PhysHlth' THEN 2.5e0 + 4 * ((tree + node) % 5) WHEN 'GenHlth' THEN 1.5e0 + (tree + node) % 4 WHEN 'Age' THEN 2.5e0 + 2 * ((tree + node) % 5)
    WHEN 'Education' THEN 2.5e0 + (tree + node) % 4 WHEN 'Income' THEN 2.5e0 + (tree + node) % 5 ELSE 0.5e0 END AS cut
    FROM range(8) AS t(tree) CROSS JOIN range(15) AS n(node) JOIN features f ON f.idx = (4 * tree + 5 * node + tree * node) % 21),
ends AS (SELECT *, (5 * tree + 13 * leaf) % (33 - low) AS medium, 32 * (1 << ((tree + leaf) % 3)::INTEGER) AS cover
    FROM (SELECT tree, leaf, (7 * tree + 11 * leaf + 3) % 29 AS low FROM range(8) AS t(tree) CROSS JOIN range(16) AS l(leaf))),
steps AS (SELECT tree, leaf, cover, unnest([15 + leaf, (14 + leaf) // 2, ((14 + leaf) // 2 - 1) // 2, (((14 + leaf) // 2 - 1) // 2 - 1) // 2]) AS node FROM ends),
covers AS (SELECT tree, node, sum(cover)::DOUBLE AS cover FROM steps GROUP BY ALL UNION ALL SELECT tree, 0, sum(cover) FROM ends GROUP BY tree),
paths AS (SELECT s.tree, s.leaf, p.feature, max(CASE WHEN s.node % 2 = 0 THEN cut ELSE -1e308 END) AS low, min(CASE WHEN s.node % 2 = 1 THEN cut ELSE 1e308 END) AS high,
    product(c.cover / above.cover) AS z FROM steps s JOIN splits p ON p.tree = s.tree AND p.node = (s.node - 1) // 2
    JOIN covers c ON c.tree = s.tree AND c.node = s.node JOIN covers above ON above.tree = s.tree AND above.node = p.node GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree, leaf ORDER BY feature) AS j FROM paths),
shapes AS (SELECT tree, leaf, {', '.join(f"coalesce(max(z) FILTER (WHERE j = {j}), 1e0) AS z{j}, max(feature) FILTER (WHERE j = {j}) AS f{j}" for j in range(1, 5))}
    FROM placed GROUP BY ALL),
hits AS (SELECT l.rid, p.tree, p.leaf, sum((l.value > low AND l.value <= high)::INTEGER << (j - 1)::INTEGER) AS code, count(*) AS m
    FROM long l JOIN placed p ON p.feature = l.feature GROUP BY ALL),
chances AS (SELECT rid, sum(low) / 256e0 AS p0, sum(medium) / 256e0 AS p1, sum(32 - low - medium) / 256e0 AS p2
    FROM hits h JOIN ends e ON e.tree = h.tree AND e.leaf = h.leaf WHERE code = (1 << m::INTEGER) - 1 GROUP BY rid),
judged AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS cls FROM chances),
met AS (SELECT h.rid, j.cls, CASE j.cls WHEN 0 THEN e.low WHEN 1 THEN e.medium ELSE 32 - e.low - e.medium END / 256e0 AS val, s.*,
    {', '.join(f"CASE WHEN s.f{j} IS NULL THEN 1e0 ELSE (code >> {j - 1} & 1)::DOUBLE END AS o{j}" for j in range(1, 5))}
    FROM hits h JOIN judged j ON j.rid = h.rid JOIN ends e ON e.tree = h.tree AND e.leaf = h.leaf JOIN shapes s ON s.tree = h.tree AND s.leaf = h.leaf),
parts AS ({' UNION ALL '.join(
    f"SELECT rid, f{j} AS feature, val * (o{j} - z{j}) * {_rest(*[k for k in range(1, 5) if k != j])} AS phi FROM met WHERE f{j} IS NOT NULL" for j in range(1, 5))}),
totals AS (SELECT rid, feature, sum(phi) AS phi FROM parts GROUP BY ALL)
"""

def _mixed(x: str) -> str:
    """A 32-bit number spread over all bits, as one expression over subqueries would repeat it: written with list steps."""
    steps = "list_transform([{x}], lambda v: xor(v, v >> 16) * 2146121005 & 4294967295)"
    steps = f"list_transform({steps}, lambda v: xor(v, v >> 15) * 2221713035 & 4294967295)"
    return f"list_transform({steps}, lambda v: xor(v, v >> 16))[1]".format(x=x)


_POISSON = [int(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(10)]
_SUPPORTS = f"""
WITH {LONG},
trees AS (SELECT tree::UBIGINT AS tree FROM range(400) AS t(tree)),
codes AS (SELECT rid, CAST(Diabetes_012 AS INTEGER) AS label, CAST('0x' || substr(md5(concat('42:tree:', rid)), 1, 8) AS UBIGINT) AS code FROM survey),
hashed AS (SELECT rid, label, tree, {_mixed("((code + (tree + 1) * 2654435761) & 4294967295)::UBIGINT")} AS u FROM codes CROSS JOIN trees),
drawn AS (SELECT rid, label, tree, {' + '.join(f'(u >= {p})::INTEGER' for p in _POISSON)} AS n FROM hashed WHERE u >= {_POISSON[0]}),
roots AS (SELECT tree, count(*) AS n_rows, {', '.join(f'coalesce(sum(n) FILTER (WHERE label = {c}), 0)::BIGINT AS d{c}' for c in CLASSES)} FROM drawn GROUP BY tree),
weighted AS (SELECT *, {', '.join(f'CASE WHEN d{c} = 0 THEN 0e0 ELSE (d0 + d1 + d2)::DOUBLE / (((d0 > 0)::INTEGER + (d1 > 0)::INTEGER + (d2 > 0)::INTEGER) * d{c})::DOUBLE END AS w{c}' for c in CLASSES)} FROM roots),
owned AS (SELECT tree, {_mixed("((tree + 1) * 2246822507 & 4294967295)::UBIGINT")} AS own FROM trees),
picked AS (SELECT tree, feature, idx FROM (SELECT tree, feature, idx, row_number() OVER (PARTITION BY tree ORDER BY h, idx) AS place
    FROM (SELECT tree, feature, idx, {_mixed("((own + (idx + 1)::UBIGINT * 3266489909) & 4294967295)::UBIGINT")} AS h FROM owned CROSS JOIN features)) WHERE place <= 4),
cells AS (SELECT d.tree, p.feature, p.idx, l.value, count(*) AS r, {', '.join(f'coalesce(sum(n) FILTER (WHERE label = {c}), 0)::BIGINT AS c{c}' for c in CLASSES)}
    FROM drawn d JOIN picked p ON p.tree = d.tree JOIN long l ON l.rid = d.rid AND l.feature = p.feature GROUP BY ALL),
edges AS (SELECT feature, value, (value + lead(value) OVER (PARTITION BY feature ORDER BY value)) / 2 AS cut FROM (SELECT DISTINCT feature, value FROM long)),
sides AS (SELECT tree, feature, idx, value, sum(r) OVER w AS lr, {', '.join(f'sum(c{c}) OVER w AS l{c}' for c in CLASSES)} FROM cells
    WINDOW w AS (PARTITION BY tree, feature ORDER BY value)),
weighed AS (SELECT s.tree, feature, idx, value, {', '.join(f'l{c}::DOUBLE * w{c} AS a{c}, (d{c} - l{c})::DOUBLE * w{c} AS b{c}' for c in CLASSES)}
    FROM sides s JOIN weighted t ON t.tree = s.tree WHERE lr >= 2 AND n_rows - lr >= 2),
scores AS (SELECT tree, feature, idx, value, (a0 * a0 + a1 * a1 + a2 * a2) / (a0 + a1 + a2) + (b0 * b0 + b1 * b1 + b2 * b2) / (b0 + b1 + b2) AS score FROM weighed),
best AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY score DESC, idx, value) AS place FROM scores)
SELECT r.tree::BIGINT AS tree, n_rows, d0 AS draws_low, d1 AS draws_medium, d2 AS draws_high, b.feature AS first_feature, e.cut AS first_cut,
    true AS adds_up, true AS leaves_hold_two
FROM roots r JOIN best b ON b.tree = r.tree AND b.place = 1 JOIN edges e ON e.feature = b.feature AND e.value = b.value
"""

_SCENARIO_COLUMNS = {
    "lower_bmi_active": {"BMI": "greatest(12e0, BMI - 5)", "PhysActivity": "1e0"},
    "good_health": {"GenHlth": "1e0", "HighBP": "0e0", "HighChol": "0e0"},
    "heavier": {"BMI": "BMI + 8", "Fruits": "0e0", "Veggies": "0e0"},
}
_EDITED = "edited AS (" + " UNION ALL ".join(
    f"SELECT concat(rid, '/{name}') AS id, rid, '{name}' AS scenario_id, "
    + ", ".join(f"{edits.get(c, c)} AS {c}" for c in COLUMNS)
    + " FROM survey"
    for name, edits in _SCENARIO_COLUMNS.items()
) + ")"
_EDITED_SCORED = f"{_EDITED}, edited_scored AS ({scored('edited', 'id')})"
_BAND = "CASE WHEN {p} > 70 THEN 'High' WHEN {p} >= 40 THEN 'Moderate' ELSE 'Low' END"
_COLOUR = "CASE WHEN {p} > 70 THEN '#FF4D4D' WHEN {p} >= 40 THEN '#FFA500' ELSE '#2ECC71' END"
_GENDER = "CASE WHEN {s} = 1 THEN 'male' ELSE 'female' END"
_OLD_TWINS = f"""
old_twins AS (SELECT v.rid + 1 AS patient_number, v.BMI AS bmi, {_GENDER.format(s='v.Sex')} AS gender, (v.BMI - 22) * 0.5e0 AS beta0,
    s.p2 * 100 AS risk_percent, {_BAND.format(p='s.p2 * 100')} AS risk_band, {_COLOUR.format(p='s.p2 * 100')} AS risk_colour
    FROM survey v JOIN scored s ON v.rid = s.rid)
"""
_NEW_TWINS = f"""
new_twins AS (SELECT e.rid + 1 AS patient_number, e.BMI AS bmi, {_GENDER.format(s='e.Sex')} AS gender, (e.BMI - 22) * 0.5e0 AS beta0,
    c.p2 * 100 AS risk_percent, {_BAND.format(p='c.p2 * 100')} AS risk_band, {_COLOUR.format(p='c.p2 * 100')} AS risk_colour
    FROM edited e JOIN edited_scored c ON e.id = c.id WHERE e.scenario_id = 'lower_bmi_active')
"""
_TWINS = f"WITH {_EDITED_SCORED}, {_OLD_TWINS}, {_NEW_TWINS}"
_STORED_TWINS = f"""{_TWINS}, stored AS (
    SELECT patient_number, bmi, CASE WHEN patient_number % 5 <> 2 THEN gender WHEN gender = 'male' THEN 'female' ELSE 'male' END AS gender,
        CASE WHEN patient_number % 5 = 1 THEN risk_percent + 0.00005e0 ELSE risk_percent END AS risk_percent
    FROM new_twins WHERE patient_number % 5 < 3
    UNION ALL SELECT patient_number, bmi, gender, risk_percent FROM old_twins WHERE patient_number % 5 = 3)"""
_IMPORTANCE = f"""importance AS (SELECT m.feature, f.idx, importance_mean, importance_std,
    row_number() OVER (ORDER BY importance_mean DESC, f.idx) AS importance_rank
    FROM (WITH {_permutation("SELECT * FROM survey").strip()}) m JOIN features f ON f.feature = m.feature)"""

ORACLES = {
    "predictions": with_tables(
        f"SELECT rid, p0, p1, p2, cls AS predicted_class, {LABEL.format(c='cls')} AS predicted_label, "
        "p2 AS high_risk_probability FROM scored",
        "scored",
    ),
    "confusion": with_tables(
        f"""
WITH {_LABELLED}
SELECT a.c AS actual, p.c AS predicted, count(j.rid) AS n_rows FROM (VALUES (0), (1), (2)) AS a(c) CROSS JOIN (VALUES (0), (1), (2)) AS p(c)
LEFT JOIN judged j ON j.actual = a.c AND j.cls = p.c GROUP BY 1, 2
""",
        "scored",
    ),
    "evaluation_scores": with_tables(
        f"""
WITH {_PER_CLASS}
SELECT any_value(n) AS n_rows, round(sum(tp) * 1e0 / any_value(n), 9) AS accuracy,
    round(avg(rec) FILTER (WHERE supp > 0), 9) AS balanced_accuracy, round(avg(f1) FILTER (WHERE supp + pred > 0), 9) AS macro_f1,
    round(sum(f1 * supp) / any_value(n), 9) AS weighted_f1 FROM figures
""",
        "scored",
    ),
    "classification_report": with_tables(
        f"""
WITH {_PER_CLASS}, acc AS (SELECT sum(tp) * 1e0 / any_value(n) AS a FROM figures)
SELECT {LABEL.format(c='c')} AS label, round(prec, 9) AS precision, round(rec, 9) AS recall, round(f1, 9) AS f1_score,
    CAST(supp AS DOUBLE) AS support FROM figures
UNION ALL SELECT 'accuracy', round(a, 9), round(a, 9), round(a, 9), round(a, 9) FROM acc
UNION ALL SELECT 'macro avg', round(avg(prec), 9), round(avg(rec), 9), round(avg(f1), 9), CAST(any_value(n) AS DOUBLE) FROM figures
UNION ALL SELECT 'weighted avg', round(sum(prec * supp) / any_value(n), 9), round(sum(rec * supp) / any_value(n), 9),
    round(sum(f1 * supp) / any_value(n), 9), CAST(any_value(n) AS DOUBLE) FROM figures
""",
        "scored",
    ),
    "one_hot": with_tables(
        "SELECT rid, c AS class_id, CASE WHEN Diabetes_012 = c THEN 1 ELSE 0 END AS is_class "
        "FROM survey CROSS JOIN (VALUES (0), (1), (2)) AS k(c)",
        "survey",
    ),
    "roc_points": with_tables(
        f"""
WITH {_CURVE}
SELECT class_id, score AS threshold, CASE WHEN n_all = 0 THEN 0e0 ELSE CAST(fp AS DOUBLE) / CAST(n_all AS DOUBLE) END AS fpr,
    CASE WHEN p_all = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / CAST(p_all AS DOUBLE) END AS tpr FROM cumulated
UNION ALL SELECT c, CAST(NULL AS DOUBLE), 0e0, 0e0 FROM (VALUES (0), (1), (2)) AS k(c)
""",
        "scored",
    ),
    "auc_by_class": with_tables(f"WITH {_CURVE} {_AUC}", "scored"),
    "macro_auc": with_tables(f"WITH {_CURVE} SELECT round(avg(auc), 9) AS macro_ovr_roc_auc FROM ({_AUC}) a", "scored"),
    "stored_evaluation": with_tables(
        f"""
WITH {_PER_CLASS}
SELECT 'demo-forest' AS model_name, any_value(n)::BIGINT AS n_rows, round(sum(tp) * 1e0 / any_value(n), 9) AS accuracy,
    round(avg(rec) FILTER (WHERE supp > 0), 9) AS balanced_accuracy, round(avg(f1) FILTER (WHERE supp + pred > 0), 9) AS macro_f1,
    (WITH {_CURVE} SELECT round(avg(auc), 9) FROM ({_AUC}) a) AS macro_roc_auc,
    round(max(rec) FILTER (WHERE c = 0), 9) AS low_recall, round(max(rec) FILTER (WHERE c = 1), 9) AS medium_recall,
    round(max(rec) FILTER (WHERE c = 2), 9) AS high_recall FROM figures
""",
        "scored",
    ),
    "prediction_pairs": with_tables(
        f"""
WITH {_EDITED_SCORED}
SELECT s.rid + 1 AS patient_number, CAST(s.cls AS INTEGER) AS baseline_class, CAST(c.cls AS INTEGER) AS scenario_class,
    s.p2 AS baseline_risk, c.p2 AS scenario_risk,
    CAST((e.BMI <> v.BMI)::INT + (e.PhysActivity <> v.PhysActivity)::INT AS INTEGER) AS n_changes
FROM edited e JOIN edited_scored c ON e.id = c.id JOIN scored s ON s.rid = e.rid JOIN survey v ON v.rid = e.rid
WHERE e.scenario_id = 'lower_bmi_active'
""",
        "scored",
    ),
    "evaluation_attached": with_tables(
        f"""
WITH {_PER_CLASS}
SELECT s.rid, s.cls AS predicted_class, 'demo-forest' AS model_name, e.accuracy, e.macro_f1, e.low_recall, e.medium_recall, e.high_recall,
    CASE WHEN e.medium_recall < 0.10 THEN concat('Model limitation: Medium (prediabetes) recall is ',
        format('{{:.2f}}', e.medium_recall * 100), '% in the checked test metrics. Do not interpret this prototype as a clinical screening system.')
    ELSE 'Model results are research outputs, not clinical diagnoses.' END AS warning
FROM scored s CROSS JOIN (SELECT round(sum(tp) * 1e0 / any_value(n), 9) AS accuracy, round(avg(f1), 9) AS macro_f1,
    round(max(rec) FILTER (WHERE c = 0), 9) AS low_recall, round(max(rec) FILTER (WHERE c = 1), 9) AS medium_recall,
    round(max(rec) FILTER (WHERE c = 2), 9) AS high_recall FROM figures) e
""",
        "scored",
    ),
    "permutation_importance": with_tables(
        "WITH "
        + SPLIT.strip()
        + ", "
        + _permutation(
            "SELECT * FROM (SELECT * FROM parts WHERE is_test) t ORDER BY md5(concat('42:sample:', rid)), rid LIMIT 1000"
        ).strip(),
        "survey",
        "leaves",
        "features",
    ),
    "permutation_importance_all": with_tables(
        "WITH " + _permutation("SELECT * FROM survey").strip(), "survey", "leaves", "features"
    ),
    "importance_ranking": with_tables(
        f"WITH {_IMPORTANCE} SELECT feature, importance_mean, importance_std, CAST(importance_rank AS INTEGER) AS importance_rank "
        "FROM importance WHERE importance_rank <= 10",
        "survey",
        "leaves",
        "features",
    ),
    "shap_contributions": with_tables(_SHAP, "scored", "features"),
    "shap_wide_forest": with_tables(
        f"""{_WIDE}
SELECT j.rid, CAST(j.cls AS INTEGER) AS predicted_class, f.feature, round(coalesce(t.phi, 0e0) + 1.7e-10, 9) AS shap_value
FROM judged j CROSS JOIN features f LEFT JOIN totals t ON t.rid = j.rid AND t.feature = f.feature
""",
        "survey",
        "features",
    ),
    "shap_additivity": with_tables(
        f"""{_WIDE},
bases AS (SELECT c, round(sum(CASE c WHEN 0 THEN low WHEN 1 THEN medium ELSE 32 - low - medium END / 32e0 * e.cover / r.cover) / 8, 9) AS base
    FROM ends e JOIN covers r ON r.tree = e.tree AND r.node = 0 CROSS JOIN (VALUES (0), (1), (2)) AS k(c) GROUP BY c)
SELECT CAST(cls AS INTEGER) AS predicted_class, any_value(base) AS base, count(*) AS n_rows, true AS adds_up
FROM judged JOIN bases ON c = cls GROUP BY cls
""",
        "survey",
        "features",
    ),
    "top_factors": with_tables(
        f"""
WITH {LONG}, placed AS (SELECT s.rid, s.feature, l.value, s.shap, row_number() OVER (PARTITION BY s.rid ORDER BY abs(shap) DESC, s.idx) AS place
    FROM shap s JOIN long l ON l.rid = s.rid AND l.feature = s.feature)
SELECT rid, CAST(place AS INTEGER) AS factor_rank, feature, value, shap AS shap_value FROM placed WHERE place <= 5
""",
        "survey",
        "shap",
    ),
    "all_factors": with_tables(
        f"""
WITH {LONG}, placed AS (SELECT s.rid, s.feature, l.value, s.shap, row_number() OVER (PARTITION BY s.rid ORDER BY abs(shap) DESC, s.idx) AS place
    FROM shap s JOIN long l ON l.rid = s.rid AND l.feature = s.feature)
SELECT rid, CAST(place AS INTEGER) AS factor_rank, feature, value, shap AS shap_value FROM placed
""",
        "survey",
        "shap",
    ),
    "supports_and_opposes": with_tables(
        """
WITH up AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY shap DESC, idx) AS place FROM shap WHERE shap > 0),
down AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY shap, idx DESC) AS place FROM shap WHERE shap < 0)
SELECT rid, 'supports' AS side, CAST(place AS INTEGER) AS factor_rank, feature, shap AS shap_value FROM up WHERE place <= 3
UNION ALL SELECT rid, 'opposes', CAST(place AS INTEGER), feature, shap FROM down WHERE place <= 2
""",
        "shap",
    ),
    "packed_contributions": with_tables(
        "SELECT rid, CAST(count(*) AS INTEGER) AS n_features, coalesce(sum(shap) FILTER (WHERE shap > 0), 0e0) AS positive, "
        "coalesce(sum(shap) FILTER (WHERE shap < 0), 0e0) AS negative FROM shap GROUP BY rid",
        "shap",
    ),
    "missing_contributions": with_tables("SELECT rid, feature FROM shap WHERE shap = 0", "shap"),
    "profile_attributes": with_tables(
        f"""
WITH {LONG}, definitions AS ({DEFINITIONS}), {_IMPORTANCE}
SELECT l.rid, l.feature, l.value, s.shap AS shap_value, d.label, d.domain_label,
    CASE WHEN d.domain = 'clinical' THEN CAST(i.importance_rank AS INTEGER) END AS importance_rank
FROM long l JOIN shap s ON s.rid = l.rid AND s.feature = l.feature JOIN definitions d ON d.feature = l.feature
JOIN importance i ON i.feature = l.feature
""",
        "survey",
        "shap",
    ),
    "scenario_scores": with_tables(
        f"""
WITH {_EDITED_SCORED}
SELECT e.rid + 1 AS patient_number, e.scenario_id, {LABEL.format(c='b.cls')} AS baseline_label, {LABEL.format(c='c.cls')} AS scenario_label,
    b.p2 AS baseline_risk, c.p2 AS scenario_risk, c.p2 - b.p2 AS high_risk_change, (c.p2 - b.p2) * 100 AS change_points,
    CASE WHEN c.p2 > b.p2 THEN 'up' WHEN c.p2 < b.p2 THEN 'down' ELSE 'none' END AS change_direction,
    {' + '.join(f'CASE WHEN e.{c} <> v.{c} THEN 1 ELSE 0 END' for c in COLUMNS)} AS n_changes
FROM edited e JOIN edited_scored c ON e.id = c.id JOIN scored b ON b.rid = e.rid JOIN survey v ON v.rid = e.rid
""",
        "scored",
    ),
    "scenario_changes": with_tables(
        f"WITH {_EDITED} "
        + " UNION ALL ".join(
            f"SELECT e.rid + 1 AS patient_number, e.scenario_id, '{c}' AS feature, v.{c} AS from_value, e.{c} AS to_value "
            f"FROM edited e JOIN survey v ON v.rid = e.rid WHERE v.{c} <> e.{c}"
            for c in COLUMNS
        ),
        "survey",
    ),
    "overrides": with_tables(
        """
WITH items AS (SELECT l_orderkey AS rid, sum(l_quantity) AS q, min(l_linenumber) AS line FROM lineitem GROUP BY 1)
SELECT v.rid + 1 AS patient_number, CASE WHEN i.rid IS NULL THEN v.BMI ELSE 12 + q % 80 END AS BMI, v.GenHlth,
    CASE WHEN i.line = 1 THEN 1e0 ELSE v.PhysActivity END AS PhysActivity, v.Fruits, v.Veggies, v.HvyAlcoholConsump,
    CASE WHEN i.rid IS NULL THEN v.HighBP ELSE q % 2 END AS HighBP, v.HighChol
FROM survey v LEFT JOIN items i ON i.rid = v.rid
""",
        "survey",
    ),
    "twins": with_tables(f"WITH {_OLD_TWINS} SELECT * FROM old_twins", "scored"),
    "stale_twins": with_tables(
        f"""{_STORED_TWINS} SELECT n.* FROM new_twins n LEFT JOIN stored o ON o.patient_number = n.patient_number AND o.bmi = n.bmi
    AND o.gender = n.gender AND abs(o.risk_percent - n.risk_percent) < 0.0001 WHERE o.patient_number IS NULL""",
        "scored",
    ),
    "current_twins": with_tables(
        f"""{_STORED_TWINS} SELECT n.* FROM new_twins n JOIN stored o ON o.patient_number = n.patient_number AND o.bmi = n.bmi
    AND abs(o.risk_percent - n.risk_percent) < 0.0001""",
        "scored",
    ),
    "refreshed_twins": with_tables(
        f"""{_STORED_TWINS} SELECT n.patient_number, coalesce(o.bmi, n.bmi) AS bmi, coalesce(o.gender, n.gender) AS gender,
    coalesce(o.risk_percent, n.risk_percent) AS risk_percent, o.patient_number IS NULL AS rewritten
    FROM new_twins n LEFT JOIN stored o ON o.patient_number = n.patient_number AND o.bmi = n.bmi
    AND o.gender = n.gender AND abs(o.risk_percent - n.risk_percent) < 0.0001""",
        "scored",
    ),
    "case_records": with_tables(
        f"""{_TWINS} SELECT o.patient_number, o.gender, o.bmi AS current_bmi, o.beta0 AS current_smpl_beta_0,
    o.risk_percent AS current_risk_percent, o.risk_band AS current_risk_band, o.risk_colour AS current_risk_colour,
    n.bmi AS scenario_bmi, n.beta0 AS scenario_smpl_beta_0, n.risk_percent AS scenario_risk_percent,
    n.risk_band AS scenario_risk_band, n.risk_colour AS scenario_risk_colour,
    concat_ws(',', CASE WHEN n.bmi <> o.bmi THEN 'BMI' END, CASE WHEN v.PhysActivity <> 1 THEN 'PhysActivity' END) AS edited,
    'This is model re-prediction after manual input edits; it is not a causal estimate or treatment recommendation.'
        AS important_limitation
FROM old_twins o JOIN new_twins n ON n.patient_number = o.patient_number JOIN survey v ON v.rid + 1 = o.patient_number""",
        "scored",
    ),
    "display_texts": with_tables(
        """
SELECT s.rid + 1 AS patient_number, concat(format('{:.1f}', s.p2 * 100), '%') AS risk_text, format('{:+.3f}', c.shap) AS shap_text,
    format('{:,}', s.rid * 12345) AS grouped
FROM scored s JOIN shap c ON c.rid = s.rid AND c.idx = 0
""",
        "scored",
        "shap",
    ),
    "reloaded_model": with_tables("SELECT count(*) AS n_rows, 0::BIGINT AS n_changed, 0::BIGINT AS n_apart, 20::BIGINT AS n_trees FROM survey", "survey"),
    "forest_supports": with_tables(_SUPPORTS, "survey", "features"),
    "stream_scores": with_tables(
        "SELECT v.rid, CAST(v.Diabetes_012 AS INTEGER) AS Diabetes_012, s.cls AS predicted_class, s.p2 AS high_risk_probability "
        "FROM survey v JOIN scored s ON v.rid = s.rid",
        "scored",
    ),
}
