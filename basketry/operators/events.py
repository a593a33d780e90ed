"""First-event and argmin-row operators (the reference's join of a fact to
its own per-key minimum, and its correlated ``= (SELECT MIN ...)``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_event(df: DataFrame, entity: str, time_col: str, name: str = "first_time") -> DataFrame:
    """entity -> earliest time (hash aggregate with map-side combine: a hot
    entity is reduced to one row per task before the shuffle)."""
    return df.groupBy(entity).agg(F.min(time_col).alias(name))


def argmin_rows(df: DataFrame, entity: str, time_col: str) -> DataFrame:
    """Rows at their entity's minimum time, ties kept.  The semi join is on
    (entity, time), so a hot entity's rows spread over its distinct times."""
    mins = first_event(df, entity, time_col, "__argmin_t").withColumnRenamed(entity, "__argmin_e")
    cond = (df[entity] == mins["__argmin_e"]) & (df[time_col] == mins["__argmin_t"])
    return df.join(mins, cond, "left_semi")
