"""Conditional-aggregate pivot: one output column per listed value.

``SUM(CASE WHEN p = v THEN x ELSE 0 END)`` per value, computed in one hash
aggregate (partial + final).  The values are always given, so no extra job
discovers them, and a group with no row for a value gets 0, not NULL, as in
the reference (Spark's ``pivot()`` would give NULL).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_sum(df: DataFrame, group_cols: Sequence[str], pivot_col: str, values: Sequence[str],
              value_col: str, name: Callable[[str], str] | None = None,
              total: str | None = None, finish: Callable[[Column], Column] | None = None) -> DataFrame:
    name = name or (lambda v: f"{v}")
    finish = finish or (lambda c: c)
    aggs = [finish(F.sum(F.when(F.col(pivot_col) == F.lit(v), F.col(value_col)).otherwise(F.lit(0))))
            .alias(name(v)) for v in values]
    if total:
        aggs.append(finish(F.sum(value_col)).alias(total))
    return df.groupBy(*group_cols).agg(*aggs)
