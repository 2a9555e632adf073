"""The four cleaning policies.

``tag`` adds two columns to every input row and drops none:

* ``dropped``    - the row is incomplete and the policy leaves it out silently;
* ``violations`` - names of broken rules, for complete rows only.

``valid`` / ``dropped`` / ``quarantine`` split the tagged rows. Where a single
file would be refused as a whole, the offending rows land in quarantine and
``require_valid`` raises. Everything is one projection per row: no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.codebook import BINARY_FEATURES, FEATURES, FIELDS, LIMITS, MISSING_TOKENS, TARGET
from vitalgrid.functions.decode import sql_text
from vitalgrid.functions.numeric import finite, infinite, to_number
from vitalgrid.functions.settle import settled
from vitalgrid.sources.survey import project, require_columns

# the target truncated to an integer
_LABEL = f"CAST({TARGET} AS INT)"


@dataclass(frozen=True)
class Cleaned:
    tagged: DataFrame

    @property
    def valid(self) -> DataFrame:
        return self.tagged.filter(~F.col("dropped") & (F.size("violations") == 0)).drop("dropped", "violations")

    @property
    def dropped(self) -> DataFrame:
        return self.tagged.filter("dropped").drop("dropped", "violations")

    @property
    def quarantine(self) -> DataFrame:
        return self.tagged.filter(F.size("violations") > 0).drop("dropped")

    def require_valid(self) -> DataFrame:
        """The valid rows, or an error naming the broken rules (one small aggregate)."""
        broken = (
            self.quarantine.select(F.explode("violations").alias("rule")).groupBy("rule").count().orderBy("rule")
        ).collect()
        if broken:
            raise ValueError("; ".join(f"{row['rule']}: {row['count']} rows" for row in broken))
        return self.valid


def _is_text(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.simpleString() == "string"


def coerced(df: DataFrame, names: list[str], keep_infinite: bool = False) -> DataFrame:
    """Numbers from text or numeric columns; bad text and NaN become NULL.

    So do infinities, unless ``keep_infinite``: an import has to refuse such a
    value by its range, not to pass over it as if it were missing.
    """
    number = {n: to_number(n) if _is_text(df, n) else finite(n) for n in names}
    if keep_infinite:
        number = {n: f"coalesce({sql}, {infinite(n, _is_text(df, n))})" for n, sql in number.items()}
    return settled(df, number)


def any_null(names: list[str]) -> str:
    return "(" + " OR ".join(f"`{n}` IS NULL" for n in names) + ")"


def _tagged(df: DataFrame, dropped: str, rules: dict[str, str]) -> DataFrame:
    """Add ``dropped`` and the names of broken rules; rules are SQL conditions."""
    nothing = "CAST(array() AS ARRAY<STRING>)"
    named = ", ".join(f"CASE WHEN {broken} THEN '{name}' END" for name, broken in rules.items())
    found = f"array_compact(array({named}))" if rules else nothing
    return settled(df, {"dropped": dropped, "violations": f"CASE WHEN {dropped} THEN {nothing} ELSE {found} END"})


def strict_load(df: DataFrame) -> Cleaned:
    """Training load without coercion: incomplete rows go, wrong labels fail the table.

    The target is truncated to an integer before it is compared with the labels.
    Text that is neither missing nor a number cannot be a model input, so it
    counts as a violation instead of becoming a missing value.
    """
    require_columns(df, with_target=True)
    raw = project(df)
    names = [*FEATURES, TARGET]
    numbers = coerced(raw, names)
    text = [n for n in names if _is_text(raw, n)]
    if not text:
        return _truncated(numbers, names, label_rule=True)
    # keep the raw text beside the number to tell "missing" from "not a number"
    tokens = ", ".join(sql_text(token) for token in MISSING_TOKENS)
    marks = raw.select("*", *[F.col(n).alias(f"_raw_{n}") for n in text])
    bad = {n: f"(`{n}` IS NULL AND _raw_{n} IS NOT NULL AND _raw_{n} NOT IN ({tokens}))" for n in text}
    both = settled(coerced(marks, names), {f"_bad_{n}": bad[n] for n in text})
    missing = " OR ".join(f"(`{n}` IS NULL AND NOT _bad_{n})" if n in text else f"`{n}` IS NULL" for n in names)
    rules = {f"{n}:not a number": f"_bad_{n}" for n in text}
    rules[f"{TARGET}:label"] = f"{_LABEL} IS NOT NULL AND {_LABEL} NOT IN (0, 1, 2)"
    tagged = _tagged(both, f"({missing})", rules)
    return Cleaned(
        tagged.withColumn(TARGET, F.expr(_LABEL)).drop(*[f"_raw_{n}" for n in text], *[f"_bad_{n}" for n in text])
    )


def _truncated(numbers: DataFrame, names: list[str], label_rule: bool) -> Cleaned:
    wrong = f"{_LABEL} NOT IN (0, 1, 2)"
    incomplete = any_null(names)
    if label_rule:
        tagged = _tagged(numbers, incomplete, {f"{TARGET}:label": wrong})
    else:
        tagged = _tagged(numbers, f"({incomplete} OR {wrong})", {})
    return Cleaned(tagged.withColumn(TARGET, F.expr(_LABEL)))


def training_clean(df: DataFrame) -> Cleaned:
    """Training and evaluation clean: coerce all, drop incomplete rows, drop other labels."""
    require_columns(df, with_target=True)
    names = [*FEATURES, TARGET]
    return _truncated(coerced(project(df), names), names, label_rule=False)


def import_rules() -> dict[str, str]:
    """Domain rules in field order: 14 binary, 7 lower and 7 upper limits."""
    rules: dict[str, str] = {}
    for name, *_ in FIELDS:
        low, high = LIMITS[name]
        if name in BINARY_FEATURES:
            rules[f"{name}:binary"] = f"{name} NOT IN (0D, 1D)"
        if low is not None:
            rules[f"{name}:below"] = f"{name} < {low}D"
        if high is not None:
            rules[f"{name}:above"] = f"{name} > {high}D"
    return rules


def label_rule() -> str:
    """Broken when the target is given but is not exactly one of the classes."""
    return f"{TARGET} IS NOT NULL AND {TARGET} NOT IN (0D, 1D, 2D)"


def import_clean(df: DataFrame, max_rows: int | None = None, keep: tuple[str, ...] = ("rid", "source_name")) -> Cleaned:
    """Import of numbered respondents: features required, target optional and exact.

    ``max_rows`` is the optional guard on the number of complete rows; it costs
    one count and is off unless asked for.
    """
    require_columns(df)
    wide = project(df, keep=keep)
    has_target = TARGET in wide.columns
    numbers = coerced(wide, [*FEATURES, *([TARGET] if has_target else [])], keep_infinite=True)
    rules = import_rules()
    if has_target:
        rules[f"{TARGET}:label"] = label_rule()
    cleaned = Cleaned(_tagged(numbers, any_null(FEATURES), rules))
    if max_rows is not None:
        complete = cleaned.tagged.filter(~F.col("dropped"))
        if complete.count() > max_rows:
            raise ValueError(f"more than {max_rows:,} complete rows")
    return cleaned


def require_rows(cleaned: Cleaned) -> Cleaned:
    """Error when no complete row is left."""
    if cleaned.tagged.filter(~F.col("dropped")).isEmpty():
        raise ValueError("no complete rows")
    return cleaned


def rule_counts(cleaned: Cleaned, rules: dict[str, str]) -> DataFrame:
    """Broken rows per rule in one aggregate over the complete rows."""
    complete = cleaned.tagged.filter(~F.col("dropped"))
    counts = complete.agg(*[F.expr(f"count_if({broken})").alias(f"_{i}") for i, broken in enumerate(rules.values())])
    rows = ", ".join(f"named_struct('rule', '{name}', 'n_rows', _{i})" for i, name in enumerate(rules))
    return counts.selectExpr(f"inline(array({rows}))")


def single_profiles(df: DataFrame) -> DataFrame:
    """One verdict per uploaded profile file (``source_name``), with its values.

    A file must hold exactly one complete row. One aggregate with map-side
    combine gives the count and, where the count is one, the row itself, so a
    file with very many rows costs no more than its count.
    """
    names = FEATURES
    numbers = coerced(df.select("source_name", *names), names)
    grouped = numbers.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.expr(f"count_if({any_null(names)})").alias("n_incomplete"),
        *[F.any_value(n).alias(n) for n in names],
    )
    problem = (
        F.when(F.col("n_rows") != 1, "not exactly one row")
        .when(F.col("n_incomplete") > 0, "missing values")
        .otherwise("ok")
    )
    return grouped.select(
        "source_name",
        "n_rows",
        problem.alias("verdict"),
        *[F.when(problem == "ok", F.col(n)).alias(n) for n in names],
    )
