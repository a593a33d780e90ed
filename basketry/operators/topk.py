"""Top-k with its global rank and NTILE, without a global sort.

RANK of a row inside the top k equals its global rank, because every row
with a larger value is in the set too; ROW_NUMBER likewise.  So the k rows
come from a TakeOrderedAndProject (per-partition top-k, then a k-way merge),
rank and row number are computed over those k rows, and NTILE needs only the
total row count, which is a scalar subquery (no cross join, no driver loop).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.global_window import OrderKey, asc


def _spark_order(ks: Sequence[OrderKey]) -> list[Column]:
    return [F.col(k.column).asc_nulls_first() if k.ascending else F.col(k.column).desc_nulls_last()
            for k in ks]


def ntile_of(rn: Column, n: Column, k: int) -> Column:
    """NTILE(k) bucket of row number ``rn`` among ``n`` rows (closed form)."""
    q = F.floor(n / F.lit(k))
    r = n - q * F.lit(k)
    big = r * (q + F.lit(1))
    return (F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1)
            .otherwise(F.floor((rn - 1 - big) / F.greatest(q, F.lit(1))) + r + 1)).cast("bigint")


def topk(df: DataFrame, k: int, order: Sequence[OrderKey], keys: Sequence[str], *,
         rank: str | None = None, row_number: str | None = None,
         ntile: tuple[str, int] | None = None, materialize: bool | None = None) -> DataFrame:
    """Top k rows by ``order`` + ``keys`` with global RANK / ROW_NUMBER /
    NTILE.  With NTILE the input is read twice (rows and count), so it is
    checkpointed first unless ``materialize=False``."""
    if materialize if materialize is not None else bool(ntile):
        df = df.checkpoint(eager=True)
    full = list(order) + [asc(c) for c in keys]
    top = df.orderBy(*_spark_order(full)).limit(k)
    if rank:
        top = top.withColumn(rank, F.rank().over(Window.orderBy(*_spark_order(order))).cast("bigint"))
    if row_number or ntile:
        rn = F.row_number().over(Window.orderBy(*_spark_order(full))).cast("bigint")
        top = top.withColumn("__tk_rn", rn)
        if ntile:
            name, tiles = ntile
            top = top.withColumn("__tk_n", df.select(F.count(F.lit(1))).scalar())
            top = top.withColumn(name, ntile_of(F.col("__tk_rn"), F.col("__tk_n"), tiles)).drop("__tk_n")
        top = top.withColumnRenamed("__tk_rn", row_number) if row_number else top.drop("__tk_rn")
    return top
