"""The declared constraints (primary keys, foreign keys, CHECK domains)
re-aimed as audits that run over tables of any size and return one small
finding table each, instead of being enforced on write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def domain_violations(df: DataFrame, table: str, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose value is outside the allowed set (NULL counts as outside),
    grouped by value: (table, column, value, rows)."""
    bad = df.where(~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False)))
    return (bad.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(table).alias("table"), F.lit(column).alias("column"), "value",
                    F.col("rows").cast("bigint").alias("rows")))


def duplicate_keys(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """One row: (table, key, rows, distinct_keys, duplicated_keys)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").cast("bigint").alias("rows"),
        F.count(F.lit(1)).cast("bigint").alias("distinct_keys"),
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("bigint").alias("duplicated_keys"),
    ).select(F.lit(table).alias("table"), F.lit(",".join(keys)).alias("key"),
             F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"), "distinct_keys",
             F.coalesce("duplicated_keys", F.lit(0).cast("bigint")).alias("duplicated_keys"))


def orphans(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str,
            child_name: str, parent_name: str) -> DataFrame:
    """One row: child rows whose non-NULL key has no parent.  Rows are counted
    per key first, so the left anti join meets each key once."""
    p = parent.select(F.col(parent_col).alias("__parent_key"))
    keys = child.where(F.col(child_col).isNotNull()).groupBy(child_col).agg(F.count(F.lit(1)).alias("n"))
    missing = keys.join(p, F.col(child_col) == F.col("__parent_key"), "left_anti")
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphan_rows")).select(
        F.lit(child_name).alias("child"), F.lit(child_col).alias("column"),
        F.lit(parent_name).alias("parent"), "orphan_rows")
