"""Fixed values of the survey: column names, limits, code meanings and wordings.

Everything here is data that results have to agree with. The jobs read these
values either as small dimension tables (``sources.dimensions``) or as literals
inside column expressions (``functions``).
"""

from __future__ import annotations

# --- fixed values: column names and order -----------------------------------
TARGET = "Diabetes_012"
FEATURES = [
    "HighBP", "HighChol", "CholCheck", "BMI", "Smoker", "Stroke",
    "HeartDiseaseorAttack", "PhysActivity", "Fruits", "Veggies",
    "HvyAlcoholConsump", "AnyHealthcare", "NoDocbcCost", "GenHlth",
    "MentHlth", "PhysHlth", "DiffWalk", "Sex", "Age", "Education", "Income",
]

# --- fixed values: class labels (short and long form) ------------------------
SHORT_LABELS = {0: "Low", 1: "Medium", 2: "High"}
LABELS = {0: "Low", 1: "Medium (prediabetes)", 2: "High (diabetes)"}

# --- fixed values: form fields (name, label, kind, default, min, max, step) ---
FIELDS = [
    ("BMI", "Body mass index (BMI)", "number", 40.0, 12.0, 100.0, 0.1),
    ("Age", "Age category (1 = 18-24, 13 = 80+)", "number", 9.0, 1.0, 13.0, 1.0),
    ("GenHlth", "General health (1 = excellent, 5 = poor)", "number", 3.0, 1.0, 5.0, 1.0),
    ("PhysHlth", "Physically unhealthy days in the past 30 days", "number", 5.0, 0.0, 30.0, 1.0),
    ("MentHlth", "Mentally unhealthy days in the past 30 days", "number", 5.0, 0.0, 30.0, 1.0),
    ("Education", "Education category (1 to 6)", "number", 4.0, 1.0, 6.0, 1.0),
    ("Income", "Income category (1 to 8)", "number", 4.0, 1.0, 8.0, 1.0),
    ("HighBP", "High blood pressure", "binary", 0.0, None, None, None),
    ("HighChol", "High cholesterol", "binary", 0.0, None, None, None),
    ("CholCheck", "Cholesterol checked in past 5 years", "binary", 1.0, None, None, None),
    ("Smoker", "Smoked at least 100 cigarettes in lifetime", "binary", 0.0, None, None, None),
    ("Stroke", "Ever had a stroke", "binary", 0.0, None, None, None),
    ("HeartDiseaseorAttack", "Coronary heart disease or heart attack", "binary", 0.0, None, None, None),
    ("PhysActivity", "Leisure-time physical activity in past 30 days", "binary", 1.0, None, None, None),
    ("Fruits", "Consumes fruit at least once per day", "binary", 1.0, None, None, None),
    ("Veggies", "Consumes vegetables at least once per day", "binary", 1.0, None, None, None),
    ("HvyAlcoholConsump", "Heavy alcohol consumption", "binary", 0.0, None, None, None),
    ("AnyHealthcare", "Has any healthcare coverage", "binary", 1.0, None, None, None),
    ("NoDocbcCost", "Could not see a doctor because of cost", "binary", 0.0, None, None, None),
    ("DiffWalk", "Serious difficulty walking", "binary", 0.0, None, None, None),
    ("Sex", "Sex (0 = female, 1 = male)", "binary", 0.0, None, None, None),
]

# --- fixed values: features a what-if scenario may replace --------------------
SCENARIO_FEATURES = [
    "BMI", "GenHlth", "PhysActivity", "Fruits", "Veggies",
    "HvyAlcoholConsump", "HighBP", "HighChol",
]

# --- fixed values: domains and attribute definitions (key, label, kind, domain)
DOMAINS = [
    ("clinical", "Clinical"),
    ("lifestyle", "Lifestyle"),
    ("health-status", "Health Status"),
    ("demographic", "Demographic"),
    ("socioeconomic", "Socioeconomic"),
    ("healthcare-access", "Healthcare Access"),
]
ATTRIBUTES = [
    ("HighBP", "High blood pressure", "binary", "clinical"),
    ("HighChol", "High cholesterol", "binary", "clinical"),
    ("CholCheck", "Cholesterol checked in past 5 years", "binary", "healthcare-access"),
    ("BMI", "Body mass index (BMI)", "number", "clinical"),
    ("Smoker", "Smoked at least 100 cigarettes", "binary", "lifestyle"),
    ("Stroke", "History of stroke", "binary", "clinical"),
    ("HeartDiseaseorAttack", "Heart disease or heart attack", "binary", "clinical"),
    ("PhysActivity", "Recent physical activity", "binary", "lifestyle"),
    ("Fruits", "Fruit consumed daily", "binary", "lifestyle"),
    ("Veggies", "Vegetables consumed daily", "binary", "lifestyle"),
    ("HvyAlcoholConsump", "Heavy alcohol consumption", "binary", "lifestyle"),
    ("AnyHealthcare", "Has healthcare coverage", "binary", "healthcare-access"),
    ("NoDocbcCost", "Could not see doctor due to cost", "binary", "healthcare-access"),
    ("GenHlth", "General health category", "ordinal", "health-status"),
    ("MentHlth", "Mentally unhealthy days", "number", "health-status"),
    ("PhysHlth", "Physically unhealthy days", "number", "health-status"),
    ("DiffWalk", "Serious difficulty walking", "binary", "health-status"),
    ("Sex", "Sex", "binary", "demographic"),
    ("Age", "Age category", "ordinal", "demographic"),
    ("Education", "Education category", "ordinal", "socioeconomic"),
    ("Income", "Income category", "ordinal", "socioeconomic"),
]

# --- fixed values: BMI ranges (id, code, label, minimum, maximum, order) ------
BMI_RANGES = [
    ("BMI:Underweight", "underweight", "Underweight", 0.0, 18.5, 1),
    ("BMI:Healthy range", "healthy", "Healthy range", 18.5, 25.0, 2),
    ("BMI:Overweight", "overweight", "Overweight", 25.0, 30.0, 3),
    ("BMI:Obesity", "obesity", "Obesity", 30.0, None, 4),
]

# --- fixed values: meaning of each code ---------------------------------------
BINARY_MEANINGS = {
    "HighBP": {0: "High blood pressure not reported", 1: "High blood pressure reported"},
    "HighChol": {0: "High cholesterol not reported", 1: "High cholesterol reported"},
    "CholCheck": {0: "No cholesterol check in past 5 years", 1: "Cholesterol checked in past 5 years"},
    "Smoker": {0: "Has not smoked 100 cigarettes", 1: "Has smoked at least 100 cigarettes"},
    "Stroke": {0: "No stroke history reported", 1: "Stroke history reported"},
    "HeartDiseaseorAttack": {0: "No heart disease or heart attack reported", 1: "Heart disease or heart attack reported"},
    "PhysActivity": {0: "No recent leisure-time physical activity", 1: "Recent leisure-time physical activity"},
    "Fruits": {0: "Fruit not consumed daily", 1: "Fruit consumed daily"},
    "Veggies": {0: "Vegetables not consumed daily", 1: "Vegetables consumed daily"},
    "HvyAlcoholConsump": {0: "Heavy alcohol consumption not reported", 1: "Heavy alcohol consumption reported"},
    "AnyHealthcare": {0: "No healthcare coverage", 1: "Has healthcare coverage"},
    "NoDocbcCost": {0: "No cost-related doctor access barrier reported", 1: "Could not see doctor due to cost"},
    "DiffWalk": {0: "No serious walking difficulty reported", 1: "Serious walking difficulty reported"},
    "Sex": {0: "Female", 1: "Male"},
}
ORDINAL_MEANINGS = {
    "Age": {
        1: "Age 18 to 24", 2: "Age 25 to 29", 3: "Age 30 to 34", 4: "Age 35 to 39",
        5: "Age 40 to 44", 6: "Age 45 to 49", 7: "Age 50 to 54", 8: "Age 55 to 59",
        9: "Age 60 to 64", 10: "Age 65 to 69", 11: "Age 70 to 74", 12: "Age 75 to 79",
        13: "Age 80 or older",
    },
    "GenHlth": {
        1: "Excellent general health", 2: "Very good general health", 3: "Good general health",
        4: "Fair general health", 5: "Poor general health",
    },
    "Education": {
        1: "Never attended school or kindergarten only", 2: "Grades 1 through 8",
        3: "Grades 9 through 11", 4: "High school graduate",
        5: "Some college or technical school", 6: "College or technical school graduate",
    },
    "Income": {
        1: "Annual household income below $10,000",
        2: "Annual household income $10,000 to $14,999",
        3: "Annual household income $15,000 to $19,999",
        4: "Annual household income $20,000 to $24,999",
        5: "Annual household income $25,000 to $34,999",
        6: "Annual household income $35,000 to $49,999",
        7: "Annual household income $50,000 to $74,999",
        8: "Annual household income $75,000 or more",
    },
}
MEANINGS = {**BINARY_MEANINGS, **ORDINAL_MEANINGS}

# --- fixed values: wording for counted days -----------------------------------
DAY_WORDS = {"MentHlth": "mentally", "PhysHlth": "physically"}

# --- fixed values: risk bands by percent (colours are part of the descriptor) --
HIGH_BAND = ("High", "#FF4D4D")          # percent > 70
MODERATE_BAND = ("Moderate", "#FFA500")  # percent >= 40
LOW_BAND = ("Low", "#2ECC71")

# --- fixed values: wording checks for a text draft ----------------------------
REQUIRED_PHRASES = {
    "has_research": ["research"],
    "has_not_advice": ["not medical advice"],
    "has_zero_recall": ["0.0"],
    "names_medium_class": ["medium", "prediabetes"],
    "has_non_causal": ["non-causal", "not a cause", "does not mean"],
}
PROHIBITED_CLAIMS = [
    "causes diabetes",
    "prevent diabetes",
    "protective effect",
    "reduces the risk",
    "reduce the risk",
    "increases the risk",
    "increase the risk",
    "risk of developing diabetes",
    "chances of diabetes",
    "strong predictor",
    "contribute to an increased likelihood",
]

# --- fixed values: sentences of the evidence summary and records --------------
INTRO_REPLACED = "The local model draft did not pass the research-safety checks, so this deterministic "
INTRO_HOSTED = "This hosted deployment uses a deterministic, safety-checked "
NO_FACTORS = "no factors"
EVIDENCE_BOUNDARY = "BRFSS observations and SHAP values are model-based associations, not clinical causes."
CASE_LIMITATION = (
    "This is model re-prediction after manual input edits; it is not a causal "
    "estimate or treatment recommendation."
)
GENERIC_WARNING = "Model results are research outputs, not clinical diagnoses."
NO_WARNING = "Model results are research outputs."
NOT_SUPPLIED = "Not supplied"

# --- fixed values: texts read_csv treats as missing (pandas documentation) -----
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

BINARY_FEATURES = [name for name, _, kind, *_ in FIELDS if kind == "binary"]
LIMITS = {name: (low, high) for name, _, _, _, low, high, _ in FIELDS}
DOMAIN_OF = {key: domain for key, _, _, domain in ATTRIBUTES}
ATTRIBUTE_LABEL = {key: label for key, label, _, _ in ATTRIBUTES}
ATTRIBUTE_KIND = {key: kind for key, _, kind, _ in ATTRIBUTES}
DOMAIN_LABEL = dict(DOMAINS)

# Sentences around computed figures, as whole templates in reading order.
LOW_RECALL_WARNING = (
    "Model limitation: Medium (prediabetes) recall is {recall} in the checked test metrics. "
    "Do not interpret this prototype as a clinical screening system."
)
SUMMARY = (
    "{intro}evidence summary is shown instead. For Patient #{number}, the research model predicted {label}. "
    "Its estimated probabilities were {shares}. These are model estimates, not a diagnosis.\n\n"
    "The largest positive SHAP contributions were {supports}. The largest negative SHAP contributions were {opposes}. "
    "Positive and negative SHAP values describe support for or opposition to this model output; they do not mean that a "
    "feature caused or prevented diabetes.\n\nA qualified healthcare professional can help interpret the recorded survey "
    "observations in their full context. Do not use this prototype to start, stop, or change medication or treatment. "
    "{warning} This summary is model-based, non-causal, for research only, and not medical advice."
)
NODE_SUMMARIES = {
    "observation": "Current {name} value is {value}.",
    "attribute": "Reusable definition for the {feature} model input.",
    "state": "Dataset-defined meaning of {name} value {value}.",
    "contribution": "{feature} {direction} the predicted class in this model output.",
}
STATE_RULE = "Dataset decoding only; not a causal medical claim."
CONTRIBUTION_MEANING = "Model support, not medical causation."
