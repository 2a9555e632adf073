"""SQL texts the checks start from, written without use of the DataFrame code."""

from __future__ import annotations

# The survey over ``orders`` in plain SQL.
SURVEY = """
SELECT rid, HighBP, HighChol, CholCheck, BMI, Smoker, Stroke, HeartDiseaseorAttack, PhysActivity, Fruits, Veggies,
    HvyAlcoholConsump, AnyHealthcare, NoDocbcCost, GenHlth, MentHlth, PhysHlth, DiffWalk, Sex, Age, Education, Income,
    CAST(CASE WHEN s >= 9 THEN 2 WHEN s = 8 AND rid % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS Diabetes_012
FROM (SELECT *, 2*HighBP + HighChol + CASE WHEN BMI >= 30 THEN 2 ELSE 0 END + CASE WHEN Age >= 9 THEN 1 ELSE 0 END
    + CASE WHEN GenHlth >= 4 THEN 2 ELSE 0 END + noise AS s
  FROM (SELECT o_orderkey AS rid,
    CAST(CASE WHEN (((o_orderkey + 1) * 7919) % 1000003) % 100 < 43 THEN 1 ELSE 0 END AS DOUBLE) AS HighBP,
    CAST(CASE WHEN (((o_orderkey + 1) * 104729) % 1000003) % 100 < 42 THEN 1 ELSE 0 END AS DOUBLE) AS HighChol,
    CAST(CASE WHEN (((o_orderkey + 1) * 1299709) % 1000003) % 100 < 96 THEN 1 ELSE 0 END AS DOUBLE) AS CholCheck,
    CAST(14 + ((((o_orderkey + 1) * 15485863) % 1000003) % 73) * 0.5e0 AS DOUBLE) AS BMI,
    CAST(CASE WHEN (((o_orderkey + 1) * 32452843) % 1000003) % 100 < 44 THEN 1 ELSE 0 END AS DOUBLE) AS Smoker,
    CAST(CASE WHEN (((o_orderkey + 1) * 49979687) % 1000003) % 100 < 4 THEN 1 ELSE 0 END AS DOUBLE) AS Stroke,
    CAST(CASE WHEN (((o_orderkey + 1) * 67867967) % 1000003) % 100 < 9 THEN 1 ELSE 0 END AS DOUBLE) AS HeartDiseaseorAttack,
    CAST(CASE WHEN (((o_orderkey + 1) * 86028121) % 1000003) % 100 < 76 THEN 1 ELSE 0 END AS DOUBLE) AS PhysActivity,
    CAST(CASE WHEN (((o_orderkey + 1) * 104395301) % 1000003) % 100 < 63 THEN 1 ELSE 0 END AS DOUBLE) AS Fruits,
    CAST(CASE WHEN (((o_orderkey + 1) * 122949823) % 1000003) % 100 < 81 THEN 1 ELSE 0 END AS DOUBLE) AS Veggies,
    CAST(CASE WHEN (((o_orderkey + 1) * 141650939) % 1000003) % 100 < 6 THEN 1 ELSE 0 END AS DOUBLE) AS HvyAlcoholConsump,
    CAST(CASE WHEN (((o_orderkey + 1) * 160481183) % 1000003) % 100 < 95 THEN 1 ELSE 0 END AS DOUBLE) AS AnyHealthcare,
    CAST(CASE WHEN (((o_orderkey + 1) * 179424673) % 1000003) % 100 < 8 THEN 1 ELSE 0 END AS DOUBLE) AS NoDocbcCost,
    CAST(1 + (((o_orderkey + 1) * 198491317) % 1000003) % 5 AS DOUBLE) AS GenHlth,
    CAST(CASE WHEN (((o_orderkey + 1) * 217645177) % 1000003) % 100 < 60 THEN 0
        ELSE (((o_orderkey + 1) * 217645177) % 1000003) % 31 END AS DOUBLE) AS MentHlth,
    CAST(CASE WHEN (((o_orderkey + 1) * 236887691) % 1000003) % 100 < 60 THEN 0
        ELSE (((o_orderkey + 1) * 236887691) % 1000003) % 31 END AS DOUBLE) AS PhysHlth,
    CAST(CASE WHEN (((o_orderkey + 1) * 256203161) % 1000003) % 100 < 17 THEN 1 ELSE 0 END AS DOUBLE) AS DiffWalk,
    CAST(CASE WHEN (((o_orderkey + 1) * 275604541) % 1000003) % 100 < 44 THEN 1 ELSE 0 END AS DOUBLE) AS Sex,
    CAST(1 + (((o_orderkey + 1) * 295075147) % 1000003) % 13 AS DOUBLE) AS Age,
    CAST(1 + (((o_orderkey + 1) * 314606869) % 1000003) % 6 AS DOUBLE) AS Education,
    CAST(1 + (((o_orderkey + 1) * 334214459) % 1000003) % 8 AS DOUBLE) AS Income,
    (((o_orderkey + 1) * 353868013) % 1000003) % 4 AS noise FROM orders) b) q
"""

COLUMNS = (
    "HighBP HighChol CholCheck BMI Smoker Stroke HeartDiseaseorAttack PhysActivity Fruits Veggies HvyAlcoholConsump "
    "AnyHealthcare NoDocbcCost GenHlth MentHlth PhysHlth DiffWalk Sex Age Education Income"
).split()
COLUMN_LIST = ", ".join(COLUMNS)

_SPOILED = {
    "BMI": "CASE WHEN rid % 101 = 0 THEN '' WHEN rid % 101 = 1 THEN 'n/a' WHEN rid % 101 = 2 THEN '1f' "
    "WHEN rid % 101 = 3 THEN 'NaN' ELSE CAST(BMI AS VARCHAR) END",
    "MentHlth": "CASE WHEN rid % 89 = 0 THEN NULL ELSE CAST(MentHlth AS VARCHAR) END",
    "HighBP": "CASE WHEN rid % 997 = 0 THEN '2' ELSE CAST(HighBP AS VARCHAR) END",
}
RAW = (
    "SELECT rid, "
    + ", ".join(f"{_SPOILED.get(c, f'CAST({c} AS VARCHAR)')} AS {c}" for c in COLUMNS)
    + """, CASE WHEN rid % 53 = 0 THEN NULL WHEN rid % 991 = 0 THEN '3.0' WHEN rid % 983 = 0 THEN '1.5'
        ELSE CAST(Diabetes_012 AS VARCHAR) END AS Diabetes_012 FROM survey"""
)
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
NUMBERS = (
    "SELECT rid, "
    + ", ".join(
        f"CASE WHEN regexp_matches({c}, '{_NUMBER}') THEN TRY_CAST({c} AS DOUBLE) END AS {c}"
        for c in [*COLUMNS, "Diabetes_012"]
    )
    + " FROM raw_survey"
)
ALL_PRESENT = " AND ".join(f"{c} IS NOT NULL" for c in COLUMNS)
BINARY = (
    "HighBP HighChol CholCheck Smoker Stroke HeartDiseaseorAttack PhysActivity Fruits Veggies HvyAlcoholConsump "
    "AnyHealthcare NoDocbcCost DiffWalk Sex"
).split()
RANGES = {
    "BMI": (12, 100), "Age": (1, 13), "GenHlth": (1, 5), "PhysHlth": (0, 30),
    "MentHlth": (0, 30), "Education": (1, 6), "Income": (1, 8),
}
VALID = " AND ".join(
    [f"{c} IN (0, 1)" for c in BINARY]
    + [f"{c} BETWEEN {lo} AND {hi}" for c, (lo, hi) in RANGES.items()]
    + ["(Diabetes_012 IS NULL OR Diabetes_012 IN (0, 1, 2))"]
)

# The demonstration forest as a leaf table.
LEAVES = """
SELECT * FROM (VALUES
(0, 0, 24, 60, 1, 3, -1e308, 0.5e0, -1e308, 1e308, -1e308, 1e308, -1e308, 3.5e0, -1e308, 1e308),
(0, 1, 8, 40, 4, 20, -1e308, 0.5e0, -1e308, 1e308, -1e308, 1e308, 3.5e0, 1e308, -1e308, 1e308),
(0, 2, 16, 36, 4, 24, 0.5e0, 1e308, -1e308, 1e308, -1e308, 29.75e0, -1e308, 1e308, -1e308, 1e308),
(0, 3, 16, 16, 4, 44, 0.5e0, 1e308, -1e308, 1e308, 29.75e0, 1e308, -1e308, 1e308, -1e308, 1e308),
(1, 0, 24, 58, 2, 4, -1e308, 1e308, -1e308, 1e308, -1e308, 29.75e0, -1e308, 1e308, -1e308, 8.5e0),
(1, 1, 16, 38, 4, 22, -1e308, 1e308, -1e308, 1e308, -1e308, 29.75e0, -1e308, 1e308, 8.5e0, 1e308),
(1, 2, 8, 44, 4, 16, -1e308, 1e308, -1e308, 1e308, 29.75e0, 1e308, -1e308, 2.5e0, -1e308, 1e308),
(1, 3, 16, 14, 6, 44, -1e308, 1e308, -1e308, 1e308, 29.75e0, 1e308, 2.5e0, 1e308, -1e308, 1e308),
(2, 0, 28, 56, 2, 6, -1e308, 1e308, -1e308, 0.5e0, -1e308, 1e308, -1e308, 3.5e0, -1e308, 1e308),
(2, 1, 20, 40, 4, 20, -1e308, 1e308, 0.5e0, 1e308, -1e308, 1e308, -1e308, 3.5e0, -1e308, 1e308),
(2, 2, 6, 34, 6, 24, -1e308, 0.5e0, -1e308, 1e308, -1e308, 1e308, 3.5e0, 1e308, -1e308, 1e308),
(2, 3, 10, 10, 6, 48, 0.5e0, 1e308, -1e308, 1e308, -1e308, 1e308, 3.5e0, 1e308, -1e308, 1e308),
(3, 0, 16, 60, 2, 2, -1e308, 1e308, -1e308, 1e308, -1e308, 24.75e0, -1e308, 1e308, -1e308, 1e308),
(3, 1, 32, 40, 4, 20, -1e308, 1e308, -1e308, 1e308, 24.75e0, 34.75e0, -1e308, 1e308, -1e308, 1e308),
(3, 2, 8, 28, 4, 32, -1e308, 0.5e0, -1e308, 1e308, 34.75e0, 1e308, -1e308, 1e308, -1e308, 1e308),
(3, 3, 8, 8, 4, 52, 0.5e0, 1e308, -1e308, 1e308, 34.75e0, 1e308, -1e308, 1e308, -1e308, 1e308))
AS m(tree, leaf, cover, w0, w1, w2, HighBP_lo, HighBP_hi, HighChol_lo, HighChol_hi, BMI_lo, BMI_hi,
     GenHlth_lo, GenHlth_hi, Age_lo, Age_hi)
"""
IN_LEAF = " AND ".join(
    f"{{r}}.{f} > m.{f}_lo AND {{r}}.{f} <= m.{f}_hi" for f in ("HighBP", "HighChol", "BMI", "GenHlth", "Age")
)
LABEL = "CASE {c} WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium (prediabetes)' WHEN 2 THEN 'High (diabetes)' END"


def scored(rows: str, key: str = "rid") -> str:
    """SQL of class probabilities and the first largest class for ``rows``."""
    return f"""
SELECT {key}, p0, p1, p2, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS cls
FROM (SELECT {key}, sum(w0) / 256e0 AS p0, sum(w1) / 256e0 AS p1, sum(w2) / 256e0 AS p2
      FROM {rows} r JOIN leaves m ON {IN_LEAF.format(r='r')} GROUP BY {key}) t
"""


# Per leaf the one or two path features, their intervals and cover shares.
_LEAF_PATHS = """
SELECT * FROM (VALUES
(60, 1, 3, 'HighBP', -1e308, 0.5e0, 32/64e0, 'GenHlth', -1e308, 3.5e0, 24/32e0),
(40, 4, 20, 'HighBP', -1e308, 0.5e0, 32/64e0, 'GenHlth', 3.5e0, 1e308, 8/32e0),
(36, 4, 24, 'HighBP', 0.5e0, 1e308, 32/64e0, 'BMI', -1e308, 29.75e0, 16/32e0),
(16, 4, 44, 'HighBP', 0.5e0, 1e308, 32/64e0, 'BMI', 29.75e0, 1e308, 16/32e0),
(58, 2, 4, 'BMI', -1e308, 29.75e0, 40/64e0, 'Age', -1e308, 8.5e0, 24/40e0),
(38, 4, 22, 'BMI', -1e308, 29.75e0, 40/64e0, 'Age', 8.5e0, 1e308, 16/40e0),
(44, 4, 16, 'BMI', 29.75e0, 1e308, 24/64e0, 'GenHlth', -1e308, 2.5e0, 8/24e0),
(14, 6, 44, 'BMI', 29.75e0, 1e308, 24/64e0, 'GenHlth', 2.5e0, 1e308, 16/24e0),
(56, 2, 6, 'GenHlth', -1e308, 3.5e0, 48/64e0, 'HighChol', -1e308, 0.5e0, 28/48e0),
(40, 4, 20, 'GenHlth', -1e308, 3.5e0, 48/64e0, 'HighChol', 0.5e0, 1e308, 20/48e0),
(34, 6, 24, 'GenHlth', 3.5e0, 1e308, 16/64e0, 'HighBP', -1e308, 0.5e0, 6/16e0),
(10, 6, 48, 'GenHlth', 3.5e0, 1e308, 16/64e0, 'HighBP', 0.5e0, 1e308, 10/16e0),
(60, 2, 2, 'BMI', -1e308, 24.75e0, 16/64e0, NULL, NULL, NULL, NULL),
(40, 4, 20, 'BMI', 24.75e0, 34.75e0, 48/64e0 * 32/48e0, NULL, NULL, NULL, NULL),
(28, 4, 32, 'BMI', 34.75e0, 1e308, 48/64e0 * 16/48e0, 'HighBP', -1e308, 0.5e0, 8/16e0),
(8, 4, 52, 'BMI', 34.75e0, 1e308, 48/64e0 * 16/48e0, 'HighBP', 0.5e0, 1e308, 8/16e0))
AS p(w0, w1, w2, fa, la, ha, za, fb, lb, hb, zb)
"""


def _value(f: str) -> str:
    return f"CASE {f} WHEN 'HighBP' THEN v.HighBP WHEN 'HighChol' THEN v.HighChol WHEN 'BMI' THEN v.BMI WHEN 'GenHlth' THEN v.GenHlth ELSE v.Age END"


# Contributions of the demonstration forest: at most two features on a path, so the subsets are written out.
CONTRIBUTIONS = f"""
SELECT rid, feature, sum(phi) AS phi FROM (
    WITH paths AS ({_LEAF_PATHS}),
    met AS (SELECT v.rid, s.cls, CASE s.cls WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END / 256e0 AS val, fa, za, fb, zb,
        CASE WHEN {_value('fa')} > la AND {_value('fa')} <= ha THEN 1e0 ELSE 0e0 END AS oa,
        CASE WHEN {_value('fb')} > lb AND {_value('fb')} <= hb THEN 1e0 ELSE 0e0 END AS ob
        FROM survey v JOIN scored s ON v.rid = s.rid CROSS JOIN paths)
    SELECT rid, fa AS feature, val * (oa - za) * CASE WHEN fb IS NULL THEN 1e0 ELSE (ob + zb) / 2e0 END AS phi FROM met
    UNION ALL SELECT rid, fb, val * (ob - zb) * (oa + za) / 2e0 FROM met WHERE fb IS NOT NULL) shares
GROUP BY rid, feature
"""

# One row per respondent and feature, in feature order, in multiples of 2 ** -30.
FEATURE_ROWS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(COLUMNS)) + ") AS f(idx, feature)"
SHAP = f"""
SELECT s.rid, f.idx, f.feature, CAST(floor(coalesce(t.phi, 0e0) * 1073741824e0 + 0.5e0) AS BIGINT)::DOUBLE / 1073741824e0 AS shap
FROM scored s CROSS JOIN features f LEFT JOIN ({CONTRIBUTIONS}) t ON t.rid = s.rid AND t.feature = f.feature
"""

# Made contributions with zeros, ties and both signs for every feature, from the respondent's id alone.
MADE_SHAP = """
SELECT rid, idx, feature, CAST(((rid + 1) * (31 + 17 * idx)) % 401 - 200 AS DOUBLE) / 1024 AS shap
FROM (SELECT o_orderkey AS rid FROM orders) o CROSS JOIN features
"""


def with_tables(body: str, *names: str) -> str:
    """``body`` with the named base tables in front, in the order they depend on."""
    texts = {
        "survey": SURVEY,
        "raw_survey": RAW,
        "numbers": NUMBERS,
        "leaves": LEAVES,
        "scored": scored("survey"),
        "features": FEATURE_ROWS,
        "shap": SHAP,
        "made_shap": MADE_SHAP,
    }
    needs = {"raw_survey": ["survey"], "numbers": ["raw_survey"], "scored": ["survey", "leaves"], "shap": ["features", "scored"], "made_shap": ["features"]}
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in needs.get(name, []):
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} AS ({texts[n]})" for n in wanted)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
