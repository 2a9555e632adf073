"""Per-respondent contribution lists.

Inside a job the 21 contributions of a respondent travel as one array column in
feature order (``shap``), so ranking them never shuffles. ``to_long`` and
``pack`` convert to and from one row per (respondent, feature).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid import codebook as cb
from vitalgrid.codebook import FEATURES
from vitalgrid.functions.decode import meaning_at, text_array
from vitalgrid.functions.numeric import number_text
from vitalgrid.operators.ordering import by_shuffle


def profile_array() -> Column:
    return F.expr(f"array({', '.join(FEATURES)})")


def missing_features() -> Column:
    """Names of features without a value, in feature order."""
    return F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in FEATURES]))


def to_long(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per respondent and feature: ``idx, feature, value, shap_value``."""
    entries = ", ".join(
        f"named_struct('idx', {i}, 'feature', '{f}', 'value', {f}, 'shap_value', get(shap, {i}))"
        for i, f in enumerate(FEATURES)
    )
    return df.select(*keep, F.expr(f"inline(array({entries}))"))


def pack(long: DataFrame, key: str) -> DataFrame:
    """Contribution rows back to one ``shap`` array per respondent.

    A conditional maximum per feature instead of a collected list: the state is
    21 numbers per respondent whatever the input repeats.
    """
    per_feature = [F.max(F.when(F.col("feature") == f, F.col("shap_value"))).alias(f"_{f}") for f in FEATURES]
    return long.groupBy(key).agg(*per_feature).select(key, F.array(*[F.col(f"_{f}") for f in FEATURES]).alias("shap"))


def missing_contributions(respondents: DataFrame, long: DataFrame, key: str) -> DataFrame:
    """(respondent, feature) pairs without a contribution.

    Counting per respondent first leaves only incomplete respondents to be
    compared feature by feature.
    """
    have = long.filter(F.col("feature").isin(FEATURES)).groupBy(key).agg(
        *[F.max(F.when(F.col("feature") == f, F.lit(True))).alias(f"_{f}") for f in FEATURES]
    )
    absent = F.array_compact(F.array(*[F.when(F.col(f"_{f}").isNull(), f) for f in FEATURES]))
    complete = reduce(lambda a, b: a & b, [F.col(f"_{f}").isNotNull() for f in FEATURES])
    return (
        respondents.select(key)
        .join(by_shuffle(have), key, "left")
        .filter(F.coalesce(~complete, F.lit(True)))
        .select(key, F.explode(absent).alias("feature"))
    )


def ranked(shap: Column, by) -> Column:
    """Feature indexes ordered by the sort fields ``by(value, index)`` gives."""
    fields = F.transform(shap, lambda v, i: F.struct(*[f.alias(f"k{n}") for n, f in enumerate(by(v, i))], i.alias("idx"), v.alias("v")))
    return F.array_sort(fields)


def top_factors(df: DataFrame, keep: list[str], k: int | None = 5) -> DataFrame:
    """The ``k`` contributions largest in size (all for ``None``), rank from 1.

    Ties keep feature order.
    """
    order = ranked(F.col("shap"), lambda v, i: [-F.abs(v), i])
    chosen = order if k is None else F.slice(order, 1, k)
    return df.select(*keep, profile_array().alias("_values"), F.posexplode(chosen).alias("_pos", "e")).select(
        *keep,
        (F.col("_pos") + 1).alias("factor_rank"),
        F.element_at(F.array(*[F.lit(f) for f in FEATURES]), F.col("e.idx") + 1).alias("feature"),
        F.element_at("_values", F.col("e.idx") + 1).alias("value"),
        F.col("e.v").alias("shap_value"),
    )


def supporting(shap: Column, k: int = 3) -> Column:
    """Entries with the largest positive values; ties in feature order."""
    return F.slice(F.filter(ranked(shap, lambda v, i: [-v, i]), lambda e: e["v"] > 0), 1, k)


def opposing(shap: Column, k: int = 2) -> Column:
    """Entries with the most negative values; ties in reverse feature order."""
    return F.slice(F.filter(ranked(shap, lambda v, i: [v, -i]), lambda e: e["v"] < 0), 1, k)


def attribute_entries(constants: dict[str, dict[str, str]], raw: bool = False) -> Column:
    """One struct per feature, in feature order, decoded inside the row.

    ``constants`` names texts that depend on the feature alone; they come from
    constant arrays by position. ``raw`` adds the position and the number itself.
    A lambda over the profile array keeps the generated code small, where 21
    unrolled structs would grow past what the JVM compiles.
    """

    def entry(value: Column, i: Column) -> Column:
        fixed = [F.get(F.expr(text_array([of[f] for f in FEATURES])), i).alias(name) for name, of in constants.items()]
        own = [i.cast("int").alias("idx"), value.alias("raw_value")] if raw else []
        return F.struct(
            *own,
            *fixed,
            number_text(value).alias("value"),
            meaning_at(i, value).alias("state"),
            F.get("shap", i).alias("shap_value"),
        )

    return F.transform(profile_array(), entry)


def attribute_list() -> Column:
    """``array<struct<key,label,kind,domain,value,state,shap_value>>`` in feature order."""
    return attribute_entries(
        {
            "key": {f: f for f in FEATURES},
            "label": cb.ATTRIBUTE_LABEL,
            "kind": cb.ATTRIBUTE_KIND,
            "domain": {f: cb.DOMAIN_LABEL[cb.DOMAIN_OF[f]] for f in FEATURES},
        }
    )


def undecodable() -> Column:
    """Features whose value has no meaning (unknown or fractional code, negative BMI)."""
    judged = F.transform(
        profile_array(),
        lambda value, i: F.when(meaning_at(i, value).isNull(), F.get(F.expr(text_array(FEATURES)), i)),
    )
    return F.array_compact(judged)
