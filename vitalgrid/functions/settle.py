"""Evaluate expressions once.

The optimizer merges neighbouring projections, so a column that later columns
use several times is computed several times, and long chains grow into code the
JVM will not compile. A generator is never merged: one-element ``inline`` keeps
the row, stays in the same stage, moves no data, and gives plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    """``df.withColumns(columns)`` with each new column computed exactly once per row.

    Columns given as SQL text (all or none) are parsed in one go.
    """
    kept = [c for c in df.columns if c not in columns]
    if all(isinstance(expr, str) for expr in columns.values()):
        fields = ", ".join(f"'{name}', {expr}" for name, expr in columns.items())
        return df.selectExpr(*[f"`{c}`" for c in kept], f"inline(array(named_struct({fields})))")
    made = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select(*kept, F.inline(F.array(made)))
