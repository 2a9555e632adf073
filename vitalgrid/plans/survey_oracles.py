"""The survey queries in plain SQL."""

from __future__ import annotations

from vitalgrid.plans.sql_base import (
    ALL_PRESENT,
    BINARY,
    COLUMN_LIST,
    COLUMNS,
    LABEL,
    RANGES,
    VALID,
    with_tables,
)

_TRAINING = f"SELECT * FROM numbers WHERE {ALL_PRESENT} AND Diabetes_012 IS NOT NULL AND trunc(Diabetes_012) IN (0, 1, 2)"
_ORDER = [*["BMI", "Age", "GenHlth", "PhysHlth", "MentHlth", "Education", "Income"], *BINARY]


def _rule_parts() -> list[tuple[str, str]]:
    parts = []
    for c in _ORDER:
        if c in RANGES:
            parts.append((f"{c}:below", f"{c} < {RANGES[c][0]}"))
            parts.append((f"{c}:above", f"{c} > {RANGES[c][1]}"))
        else:
            parts.append((f"{c}:binary", f"{c} NOT IN (0, 1)"))
    parts.append(("Diabetes_012:label", "Diabetes_012 IS NOT NULL AND Diabetes_012 NOT IN (0, 1, 2)"))
    return parts


_VIOLATIONS = "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in _rule_parts()) + ")"
_NUMBERED = (
    f"numbered AS (SELECT *, row_number() OVER (ORDER BY rid) AS patient_number FROM numbers "
    f"WHERE {ALL_PRESENT} AND {VALID})"
)
_ACTUAL = f"coalesce({LABEL.format(c='CAST(trunc(Diabetes_012) AS INTEGER)')}, 'Not supplied')"
_REQUESTS = "requests AS (SELECT DISTINCT l_orderkey + l_partkey + 1 AS patient_number FROM lineitem)"
_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT rid, {i} AS idx, '{c}' AS feature, {c} AS value FROM survey" for i, c in enumerate(COLUMNS)
) + ")"

# Domains and attributes of the dataset.
_DOMAIN_VALUES = """
(VALUES ('clinical', 'Clinical'), ('lifestyle', 'Lifestyle'), ('health-status', 'Health Status'),
 ('demographic', 'Demographic'), ('socioeconomic', 'Socioeconomic'), ('healthcare-access', 'Healthcare Access'))
"""
# One row per feature.
ATTRIBUTE_VALUES = """
(VALUES (0, 'HighBP', 'High blood pressure', 'binary', 'clinical'),
 (1, 'HighChol', 'High cholesterol', 'binary', 'clinical'),
 (2, 'CholCheck', 'Cholesterol checked in past 5 years', 'binary', 'healthcare-access'),
 (3, 'BMI', 'Body mass index (BMI)', 'number', 'clinical'),
 (4, 'Smoker', 'Smoked at least 100 cigarettes', 'binary', 'lifestyle'),
 (5, 'Stroke', 'History of stroke', 'binary', 'clinical'),
 (6, 'HeartDiseaseorAttack', 'Heart disease or heart attack', 'binary', 'clinical'),
 (7, 'PhysActivity', 'Recent physical activity', 'binary', 'lifestyle'),
 (8, 'Fruits', 'Fruit consumed daily', 'binary', 'lifestyle'),
 (9, 'Veggies', 'Vegetables consumed daily', 'binary', 'lifestyle'),
 (10, 'HvyAlcoholConsump', 'Heavy alcohol consumption', 'binary', 'lifestyle'),
 (11, 'AnyHealthcare', 'Has healthcare coverage', 'binary', 'healthcare-access'),
 (12, 'NoDocbcCost', 'Could not see doctor due to cost', 'binary', 'healthcare-access'),
 (13, 'GenHlth', 'General health category', 'ordinal', 'health-status'),
 (14, 'MentHlth', 'Mentally unhealthy days', 'number', 'health-status'),
 (15, 'PhysHlth', 'Physically unhealthy days', 'number', 'health-status'),
 (16, 'DiffWalk', 'Serious difficulty walking', 'binary', 'health-status'),
 (17, 'Sex', 'Sex', 'binary', 'demographic'),
 (18, 'Age', 'Age category', 'ordinal', 'demographic'),
 (19, 'Education', 'Education category', 'ordinal', 'socioeconomic'),
 (20, 'Income', 'Income category', 'ordinal', 'socioeconomic'))
"""
DEFINITIONS = f"""
SELECT a.display_order, a.feature, a.label, a.kind, a.domain, d.domain_label
FROM {ATTRIBUTE_VALUES} AS a(display_order, feature, label, kind, domain)
JOIN {_DOMAIN_VALUES} AS d(domain, domain_label) ON a.domain = d.domain
"""
VALUE_MEANINGS = """
SELECT * FROM (VALUES
('HighBP', 0, 'High blood pressure not reported'), ('HighBP', 1, 'High blood pressure reported'),
('HighChol', 0, 'High cholesterol not reported'), ('HighChol', 1, 'High cholesterol reported'),
('CholCheck', 0, 'No cholesterol check in past 5 years'), ('CholCheck', 1, 'Cholesterol checked in past 5 years'),
('Smoker', 0, 'Has not smoked 100 cigarettes'), ('Smoker', 1, 'Has smoked at least 100 cigarettes'),
('Stroke', 0, 'No stroke history reported'), ('Stroke', 1, 'Stroke history reported'),
('HeartDiseaseorAttack', 0, 'No heart disease or heart attack reported'),
('HeartDiseaseorAttack', 1, 'Heart disease or heart attack reported'),
('PhysActivity', 0, 'No recent leisure-time physical activity'), ('PhysActivity', 1, 'Recent leisure-time physical activity'),
('Fruits', 0, 'Fruit not consumed daily'), ('Fruits', 1, 'Fruit consumed daily'),
('Veggies', 0, 'Vegetables not consumed daily'), ('Veggies', 1, 'Vegetables consumed daily'),
('HvyAlcoholConsump', 0, 'Heavy alcohol consumption not reported'), ('HvyAlcoholConsump', 1, 'Heavy alcohol consumption reported'),
('AnyHealthcare', 0, 'No healthcare coverage'), ('AnyHealthcare', 1, 'Has healthcare coverage'),
('NoDocbcCost', 0, 'No cost-related doctor access barrier reported'), ('NoDocbcCost', 1, 'Could not see doctor due to cost'),
('DiffWalk', 0, 'No serious walking difficulty reported'), ('DiffWalk', 1, 'Serious walking difficulty reported'),
('Sex', 0, 'Female'), ('Sex', 1, 'Male'),
('Age', 1, 'Age 18 to 24'), ('Age', 2, 'Age 25 to 29'), ('Age', 3, 'Age 30 to 34'), ('Age', 4, 'Age 35 to 39'),
('Age', 5, 'Age 40 to 44'), ('Age', 6, 'Age 45 to 49'), ('Age', 7, 'Age 50 to 54'), ('Age', 8, 'Age 55 to 59'),
('Age', 9, 'Age 60 to 64'), ('Age', 10, 'Age 65 to 69'), ('Age', 11, 'Age 70 to 74'), ('Age', 12, 'Age 75 to 79'),
('Age', 13, 'Age 80 or older'),
('GenHlth', 1, 'Excellent general health'), ('GenHlth', 2, 'Very good general health'), ('GenHlth', 3, 'Good general health'),
('GenHlth', 4, 'Fair general health'), ('GenHlth', 5, 'Poor general health'),
('Education', 1, 'Never attended school or kindergarten only'), ('Education', 2, 'Grades 1 through 8'),
('Education', 3, 'Grades 9 through 11'), ('Education', 4, 'High school graduate'),
('Education', 5, 'Some college or technical school'), ('Education', 6, 'College or technical school graduate'),
('Income', 1, 'Annual household income below $10,000'), ('Income', 2, 'Annual household income $10,000 to $14,999'),
('Income', 3, 'Annual household income $15,000 to $19,999'), ('Income', 4, 'Annual household income $20,000 to $24,999'),
('Income', 5, 'Annual household income $25,000 to $34,999'), ('Income', 6, 'Annual household income $35,000 to $49,999'),
('Income', 7, 'Annual household income $50,000 to $74,999'), ('Income', 8, 'Annual household income $75,000 or more'))
AS v(feature, code, label)
"""
_BMI_CLASS = """CASE WHEN {v} < 0 THEN NULL WHEN {v} < 18.5 THEN 'Underweight' WHEN {v} < 25 THEN 'Healthy range'
    WHEN {v} < 30 THEN 'Overweight' ELSE 'Obesity' END"""
# decoded long rows: needs the tables ``survey`` and ``meanings``
LONG = _LONG
DECODED = f"""
SELECT l.rid, l.idx, l.feature, l.value,
    CASE WHEN l.value = floor(l.value) THEN CAST(CAST(l.value AS BIGINT) AS VARCHAR) ELSE format('{{:g}}', l.value) END AS value_text,
    CASE WHEN l.feature = 'BMI' THEN {_BMI_CLASS.format(v='l.value')}
         WHEN l.feature = 'MentHlth' THEN concat(CAST(l.value AS INTEGER), ' mentally unhealthy day',
              CASE WHEN l.value = 1 THEN '' ELSE 's' END, ' in past 30 days')
         WHEN l.feature = 'PhysHlth' THEN concat(CAST(l.value AS INTEGER), ' physically unhealthy day',
              CASE WHEN l.value = 1 THEN '' ELSE 's' END, ' in past 30 days')
         ELSE m.label END AS state
FROM long l LEFT JOIN meanings m ON m.feature = l.feature AND m.code = l.value
"""
_FIELDS = """
(VALUES ('BMI', 'Body mass index (BMI)', 'number', 40e0, 12e0, 100e0, 0.1e0),
('Age', 'Age category (1 = 18-24, 13 = 80+)', 'number', 9e0, 1e0, 13e0, 1e0),
('GenHlth', 'General health (1 = excellent, 5 = poor)', 'number', 3e0, 1e0, 5e0, 1e0),
('PhysHlth', 'Physically unhealthy days in the past 30 days', 'number', 5e0, 0e0, 30e0, 1e0),
('MentHlth', 'Mentally unhealthy days in the past 30 days', 'number', 5e0, 0e0, 30e0, 1e0),
('Education', 'Education category (1 to 6)', 'number', 4e0, 1e0, 6e0, 1e0),
('Income', 'Income category (1 to 8)', 'number', 4e0, 1e0, 8e0, 1e0),
('HighBP', 'High blood pressure', 'binary', 0e0, NULL, NULL, NULL),
('HighChol', 'High cholesterol', 'binary', 0e0, NULL, NULL, NULL),
('CholCheck', 'Cholesterol checked in past 5 years', 'binary', 1e0, NULL, NULL, NULL),
('Smoker', 'Smoked at least 100 cigarettes in lifetime', 'binary', 0e0, NULL, NULL, NULL),
('Stroke', 'Ever had a stroke', 'binary', 0e0, NULL, NULL, NULL),
('HeartDiseaseorAttack', 'Coronary heart disease or heart attack', 'binary', 0e0, NULL, NULL, NULL),
('PhysActivity', 'Leisure-time physical activity in past 30 days', 'binary', 1e0, NULL, NULL, NULL),
('Fruits', 'Consumes fruit at least once per day', 'binary', 1e0, NULL, NULL, NULL),
('Veggies', 'Consumes vegetables at least once per day', 'binary', 1e0, NULL, NULL, NULL),
('HvyAlcoholConsump', 'Heavy alcohol consumption', 'binary', 0e0, NULL, NULL, NULL),
('AnyHealthcare', 'Has any healthcare coverage', 'binary', 1e0, NULL, NULL, NULL),
('NoDocbcCost', 'Could not see a doctor because of cost', 'binary', 0e0, NULL, NULL, NULL),
('DiffWalk', 'Serious difficulty walking', 'binary', 0e0, NULL, NULL, NULL),
('Sex', 'Sex (0 = female, 1 = male)', 'binary', 0e0, NULL, NULL, NULL))
AS f(feature, field_label, field_kind, default_value, minimum, maximum, step)
"""
# Rows of the test part: per class the smallest digests up to the class's quota.
SPLIT = """
counted AS (SELECT Diabetes_012, count(*) AS n_class FROM survey GROUP BY 1),
sized AS (SELECT *, sum(n_class) OVER () AS n FROM counted),
trained AS (SELECT *, n - CAST(ceil(n * 0.2e0) AS BIGINT) AS n_train FROM sized),
shares AS (SELECT *, (n_class::HUGEINT * n_train) // n AS whole, (n_class::HUGEINT * n_train) % n AS rest FROM trained),
quotas AS (SELECT Diabetes_012, n_class - whole - CASE WHEN row_number() OVER (ORDER BY rest DESC, Diabetes_012)
    <= n_train - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
placed AS (SELECT *, row_number() OVER (PARTITION BY Diabetes_012 ORDER BY md5(concat('42:', rid)), rid) AS place FROM survey),
parts AS (SELECT p.*, p.place <= q.quota AS is_test FROM placed p JOIN quotas q ON p.Diabetes_012 = q.Diabetes_012)
"""
_WINDOW_START = "greatest(0, least(r.patient_number - 1 - 4, n.n - 9))"

ORACLES = {
    "class_summary": with_tables(
        f"""
SELECT class_id, {LABEL.format(c='class_id')} AS label, n_rows, n_rows * 100.0e0 / sum(n_rows) OVER () AS percentage
FROM (SELECT CAST(trunc(Diabetes_012) AS INTEGER) AS class_id, count(*) AS n_rows FROM ({_TRAINING}) t GROUP BY 1) c
""",
        "numbers",
    ),
    "clean_training": with_tables(
        f"SELECT rid, {COLUMN_LIST}, CAST(trunc(Diabetes_012) AS INTEGER) AS Diabetes_012 FROM ({_TRAINING}) t", "numbers"
    ),
    "clean_strict": with_tables(
        f"""
SELECT n.rid, CASE WHEN r.BMI = '1f' AND NOT (r.MentHlth IS NULL OR r.Diabetes_012 IS NULL) THEN FALSE
        ELSE NOT ({ALL_PRESENT.replace('BMI', 'n.BMI')} AND n.Diabetes_012 IS NOT NULL) END AS dropped,
    CASE WHEN r.MentHlth IS NULL OR r.Diabetes_012 IS NULL OR r.BMI IN ('', 'n/a', 'NaN') THEN ''
         ELSE concat_ws(',', CASE WHEN r.BMI = '1f' THEN 'BMI:not a number' END,
              CASE WHEN trunc(n.Diabetes_012) NOT IN (0, 1, 2) THEN 'Diabetes_012:label' END) END AS violations,
    CAST(trunc(n.Diabetes_012) AS INTEGER) AS target
FROM numbers n JOIN (SELECT rid, BMI, MentHlth, Diabetes_012 FROM raw_survey) r USING (rid)
""".replace(
            ALL_PRESENT.replace("BMI", "n.BMI"), " AND ".join(f"n.{c} IS NOT NULL" for c in COLUMNS)
        ),
        "numbers",
    ),
    "clean_import": with_tables(
        f"SELECT rid, {COLUMN_LIST}, Diabetes_012, {_VIOLATIONS} AS violations FROM numbers WHERE {ALL_PRESENT}", "numbers"
    ),
    "import_rule_counts": with_tables(
        f"WITH complete AS (SELECT * FROM numbers WHERE {ALL_PRESENT}) "
        + " UNION ALL ".join(
            f"SELECT '{name}' AS rule, count(*) FILTER (WHERE {cond}) AS n_rows FROM complete" for name, cond in _rule_parts()
        ),
        "numbers",
    ),
    "single_profiles": with_tables(
        f"""
WITH grouped AS (SELECT concat('profile-', o.o_custkey, '.csv') AS source_name, count(*) AS n_rows,
    count(*) FILTER (WHERE NOT ({ALL_PRESENT})) AS bad, {', '.join(f'min(n.{c}) AS {c}' for c in COLUMNS)}
    FROM numbers n JOIN orders o ON n.rid = o.o_orderkey GROUP BY 1),
judged AS (SELECT *, CASE WHEN n_rows <> 1 THEN 'not exactly one row' WHEN bad > 0 THEN 'missing values' ELSE 'ok' END AS verdict
    FROM grouped)
SELECT source_name, n_rows, verdict, {', '.join(f"CASE WHEN verdict = 'ok' THEN {c} END AS {c}" for c in COLUMNS)} FROM judged
""",
        "numbers",
    ),
    "csv_import": with_tables(
        f"SELECT rid, {COLUMN_LIST}, Diabetes_012, true AS named, true AS in_order FROM numbers WHERE {ALL_PRESENT} AND {VALID}",
        "numbers",
    ),
    "upload_audit": with_tables(
        """
SELECT CASE rid % 3 WHEN 0 THEN 'features' WHEN 1 THEN 'labelled' ELSE 'lacking' END AS kind, CASE rid % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'extra' ELSE 'missing' END AS verdict,
    CASE rid % 3 WHEN 2 THEN 'Age,BMI' ELSE '' END AS missing, CASE rid % 3 WHEN 1 THEN 'Diabetes_012' ELSE '' END AS extra, count(*) AS n_rows
FROM survey GROUP BY ALL UNION ALL SELECT 'headers', 'empty', '', '', 0
""",
        "survey",
    ),
    "audited_import": with_tables(
        f"SELECT {COLUMN_LIST}, CASE WHEN rid % 3 = 1 THEN Diabetes_012 END AS Diabetes_012, count(*) AS n_rows FROM survey WHERE rid % 3 < 2 GROUP BY ALL",
        "survey",
    ),
    "import_guards": with_tables(
        f"""
WITH c AS (SELECT count(*) AS n FROM numbers WHERE {ALL_PRESENT})
SELECT 'cap below' AS guard, n AS n_complete, true AS refused FROM c UNION ALL SELECT 'cap reached', n, false FROM c
UNION ALL SELECT 'no complete row', 0, true UNION ALL SELECT 'some complete rows', n, false FROM c
""",
        "numbers",
    ),
    "row_counts": with_tables(
        f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE {ALL_PRESENT}) AS n_complete,
    count(*) FILTER (WHERE {ALL_PRESENT} AND {VALID}) AS n_valid, count(Diabetes_012) AS n_labelled FROM numbers
""",
        "numbers",
    ),
    "unknown_labels": with_tables(
        "SELECT DISTINCT CAST(trunc(Diabetes_012) AS INTEGER) AS class_id FROM numbers "
        "WHERE Diabetes_012 IS NOT NULL AND trunc(Diabetes_012) NOT IN (0, 1, 2)",
        "numbers",
    ),
    "missing_in_profile": with_tables(
        "SELECT rid, concat_ws(',', "
        + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in COLUMNS)
        + f") AS missing FROM numbers WHERE NOT ({ALL_PRESENT})",
        "numbers",
    ),
    "number_respondents": with_tables(f"WITH {_NUMBERED} SELECT rid, patient_number FROM numbered", "numbers"),
    "recorded_labels": with_tables(
        f"WITH {_NUMBERED} SELECT patient_number, {_ACTUAL} AS actual_label FROM numbered", "numbers"
    ),
    "neighbour_windows": with_tables(
        f"""
WITH {_NUMBERED}, n AS (SELECT count(*) AS n FROM numbered)
SELECT r.patient_number AS requested, x.patient_number, x.BMI AS bmi, CAST(x.Age AS INTEGER) AS age,
    CASE WHEN x.Sex = 1 THEN 'Male' ELSE 'Female' END AS sex, {_ACTUAL.replace('Diabetes_012', 'x.Diabetes_012')} AS actual_label
FROM numbered r CROSS JOIN n JOIN numbered x
  ON x.patient_number > {_WINDOW_START} AND x.patient_number <= least(n.n, {_WINDOW_START} + 9)
""",
        "numbers",
    ),
    "lookup_by_number": with_tables(
        f"""
WITH {_NUMBERED}, {_REQUESTS}
SELECT patient_number, rid, {COLUMN_LIST} FROM numbered WHERE patient_number IN (SELECT patient_number FROM requests)
""",
        "numbers",
    ),
    "out_of_range_requests": with_tables(
        f"""
WITH {_NUMBERED}, {_REQUESTS}
SELECT patient_number FROM requests WHERE patient_number < 1 OR patient_number > (SELECT count(*) FROM numbered)
""",
        "numbers",
    ),
    "decode_profiles": with_tables(
        f"WITH {_LONG}, meanings AS ({VALUE_MEANINGS}), decoded AS ({DECODED}) "
        "SELECT rid, feature, value_text, state FROM decoded",
        "survey",
    ),
    "attribute_overview": with_tables(
        f"""
WITH {_LONG}, definitions AS ({DEFINITIONS})
SELECT d.display_order, d.feature, d.label, d.kind, d.domain, d.domain_label, count(*) AS n_rows,
    count(DISTINCT l.value) AS n_values, sum(l.value) AS value_sum
FROM long l JOIN definitions d ON l.feature = d.feature GROUP BY ALL
""",
        "survey",
    ),
    "value_usage": with_tables(
        f"""
WITH {_LONG}, meanings AS ({VALUE_MEANINGS})
SELECT concat(m.feature, ':', m.code) AS value_id, m.feature, m.code, m.label, count(l.rid) AS n_rows
FROM meanings m LEFT JOIN long l ON l.feature = m.feature AND l.value = m.code GROUP BY ALL
""",
        "survey",
    ),
    "bmi_categories": with_tables(
        """
SELECT concat('BMI:', label) AS category_id, code AS category_code, label AS category_label, count(*) AS n_rows,
    min(BMI) AS min_bmi, max(BMI) AS max_bmi
FROM survey JOIN (VALUES ('underweight', 'Underweight', 0.0e0, 18.5e0), ('healthy', 'Healthy range', 18.5e0, 25.0e0),
  ('overweight', 'Overweight', 25.0e0, 30.0e0), ('obesity', 'Obesity', 30.0e0, NULL)) AS c(code, label, lo, hi)
  ON BMI >= lo AND (hi IS NULL OR BMI < hi) GROUP BY ALL
""",
        "survey",
    ),
    "field_limits": with_tables(
        f"""
WITH {_LONG}
SELECT f.*, min(l.value) AS seen_min, max(l.value) AS seen_max FROM {_FIELDS} JOIN long l ON l.feature = f.feature GROUP BY ALL
""",
        "survey",
    ),
    "definition_check": with_tables(
        f"""
WITH {_LONG}, definitions AS ({DEFINITIONS}), answered AS (SELECT feature, count(*) AS n FROM long GROUP BY 1)
SELECT coalesce(a.feature, d.feature) AS feature, coalesce(a.n, 0) AS n_answers, d.feature IS NOT NULL AS defined
FROM answered a FULL JOIN definitions d ON a.feature = d.feature
""",
        "survey",
    ),
    "whole_codes": with_tables(
        "SELECT rid, value, CASE WHEN value = floor(value) THEN CAST(value AS INTEGER) END AS code "
        "FROM (SELECT rid, Age + CASE WHEN rid % 7 = 0 THEN 0.5e0 ELSE 0e0 END AS value FROM survey) v",
        "survey",
    ),
    "slugs": "SELECT p_partkey, trim(regexp_replace(lower(concat_ws(' ', p_name, p_brand, p_type)), '[^a-z0-9]', '-', 'g'), '-') "
    "AS slug FROM part",
    "number_texts": """
SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)
        ELSE format('{:g}', o_totalprice) END AS price_text,
    CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS whole_text,
    CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE format('{:g}', x) END AS small_text
FROM (SELECT *, o_totalprice / 4096 + 10 AS x FROM orders) o
""",
    "stratified_split": with_tables(f"WITH {SPLIT} SELECT rid, Diabetes_012, is_test FROM parts", "survey"),
    "split_counts": with_tables(
        f"WITH {SPLIT} SELECT Diabetes_012, count(*) FILTER (WHERE is_test) AS n_test, "
        "count(*) FILTER (WHERE NOT is_test) AS n_train FROM parts GROUP BY 1",
        "survey",
    ),
    "class_weights": with_tables(
        """
SELECT Diabetes_012, count(*) AS n_class, (SELECT count(*) FROM survey) * 1e0
    / ((SELECT count(DISTINCT Diabetes_012) FROM survey) * count(*)) AS weight
FROM survey GROUP BY 1
""",
        "survey",
    ),
    "first_high_test_row": with_tables(
        f"WITH {SPLIT} SELECT rid FROM parts WHERE is_test AND Diabetes_012 = 2 ORDER BY place LIMIT 1", "survey"
    ),
    "sampled_labels": with_tables(
        "SELECT rid, Diabetes_012 FROM survey ORDER BY md5(concat('42:sample:', rid)), rid LIMIT 1000", "survey"
    ),
}
