"""Meaning of survey codes as column expressions generated from the codebook."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalgrid import codebook as cb
from vitalgrid.functions.numeric import number_text, whole_code


def sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(values: list[str | None]) -> str:
    """SQL array literal of texts."""
    return "array(" + ", ".join("CAST(NULL AS STRING)" if v is None else sql_text(v) for v in values) + ")"


def literal_map(mapping: dict) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])


def bmi_range(value: Column, field: str = "label") -> Column:
    """``id``, ``code`` or ``label`` of the half-open BMI range; NULL below zero."""
    position = {"id": 0, "code": 1, "label": 2}[field]
    expr = F.lit(None).cast("string")
    for row in reversed(cb.BMI_RANGES):
        low, high = row[3], row[4]
        inside = value >= low if high is None else (value >= low) & (value < high)
        expr = F.when(inside, row[position]).otherwise(expr)
    return expr


def days_meaning(value: Column, word: str) -> Column:
    days = whole_code(value)
    return F.concat(
        days.cast("string"),
        F.lit(f" {word} unhealthy day"),
        F.when(days == 1, "").otherwise("s"),
        F.lit(" in past 30 days"),
    )


def meaning(feature: str, value: Column) -> Column:
    """Decoded state of one feature; NULL when the code has no meaning."""
    if feature == "BMI":
        return bmi_range(value)
    if feature in cb.DAY_WORDS:
        return days_meaning(value, cb.DAY_WORDS[feature])
    if feature in cb.MEANINGS:
        return F.try_element_at(literal_map(cb.MEANINGS[feature]), whole_code(value))
    return number_text(value)


def meaning_at(index: Column, value: Column) -> Column:
    """Decoded state of the feature at ``index`` (feature order): one lookup for all features.

    The code meanings are one constant array of arrays, indexed by feature and code.
    """
    last = max(max(codes) for codes in cb.MEANINGS.values())
    rows = [
        text_array([cb.MEANINGS.get(f, {}).get(code) for code in range(last + 1)]) for f in cb.FEATURES
    ]
    coded = F.get(F.get(F.expr(f"array({', '.join(rows)})"), index), whole_code(value))
    expr = F.when(index == cb.FEATURES.index("BMI"), bmi_range(value))
    for name, word in cb.DAY_WORDS.items():
        expr = expr.when(index == cb.FEATURES.index(name), days_meaning(value, word))
    return expr.otherwise(coded)


def slug(text: Column) -> Column:
    """Lower-case letters and digits; every other character a dash; ends trimmed."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]", "-"), F.lit("-"))


def slug_of(name: str) -> str:
    """``slug`` of a column name known when the plan is built."""
    return "".join(c if c.isascii() and c.isalnum() else "-" for c in name.lower()).strip("-")
