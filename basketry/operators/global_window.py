"""Global ordinal windows without a single-partition sort.

``RANK() / ROW_NUMBER() / NTILE(k) / SUM(x) OVER (ORDER BY ...)`` with no
PARTITION BY makes Spark move every row into one task.  Here, at every size:

1. Spark's range partitioner cuts the rows into ``buckets`` contiguous
   buckets by the *full* sort key (order columns, then the tie-break keys),
   so even one value that holds a third of all rows is spread over many;
2. Spark's own windows number the rows inside each bucket; a checkpoint
   freezes the bucket ids together with those numbers, so a lost executor
   cannot move a row to another bucket;
3. one row of totals per bucket (count, sum, first and last tuple) is
   aggregated, and windows over these ``buckets`` rows turn the totals into
   offsets;
4. the offsets are joined back on the bucket.  That table has one row per
   bucket, so its broadcast is bounded by the ``buckets`` parameter (default:
   ``spark.sql.shuffle.partitions``), whatever the data.

RANK: the rows tied with the first tuple of a bucket may begin in an earlier
bucket; the position where each bucket's last tie group begins is carried
from bucket to bucket in step 3.  NTILE uses the closed form from the global
row number and the row count.  A running SUM is NULL until the first value
that is not NULL, as in SQL.  Ties in NTILE/ROW_NUMBER are broken by the
given keys, else by a hash of the row (the reference leaves them undefined;
SURVEY D12).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class OrderKey:
    column: str
    ascending: bool = True


def asc(c: str) -> OrderKey:
    return OrderKey(c, True)


def desc(c: str) -> OrderKey:
    return OrderKey(c, False)


@dataclass(frozen=True)
class GlobalSpec:
    """One global window: its ORDER BY, tie-break keys and outputs.

    row_number:   output name for ROW_NUMBER() over order + keys.
    rank:         output name for RANK() over ``order`` only.
    ntile:        (name, k) for NTILE(k) over order + keys.
    running_sum:  (name, column) for SUM(column) ROWS UNBOUNDED PRECEDING.
    """

    order: tuple[OrderKey, ...]
    keys: tuple[str, ...] = ()
    row_number: str | None = None
    rank: str | None = None
    ntile: tuple[str, int] | None = None
    running_sum: tuple[str, str] | None = None


_B, _TIE, _RN, _RANK, _SUM = "__gw_bucket", "__gw_tie", "__gw_rn", "__gw_rank", "__gw_sum"


def _spark_order(ks: Sequence[OrderKey]) -> list[Column]:
    return [F.col(k.column).asc_nulls_first() if k.ascending else F.col(k.column).desc_nulls_last()
            for k in ks]


def bucketed(df: DataFrame, order: Sequence[OrderKey], buckets: int) -> DataFrame:
    """``df`` with its range bucket in the given order (ids ascend with it)."""
    return df.repartitionByRange(buckets, *_spark_order(order)).withColumn(_B, F.spark_partition_id())


def _offsets(numbered: DataFrame, spec: GlobalSpec) -> DataFrame:
    """One row per bucket: rows before it, rows in all, sum before it, and
    the global position where its first tie group begins."""
    tuple_ = F.struct(*[F.col(k.column) for k in spec.order])
    last = F.max(F.struct(F.col(_RN), F.col(_RANK), tuple_.alias("t")))
    totals = [F.count(F.lit(1)).alias("n"), last.alias("last"),
              F.min(F.when(F.col(_RN) == 1, tuple_)).alias("first")]
    if spec.running_sum:
        totals.append(F.sum(spec.running_sum[1]).alias("s"))
    per = numbered.groupBy(_B).agg(*totals)
    w = Window.orderBy(_B)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = [F.col(_B), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__gw_off"),
            F.sum("n").over(Window.partitionBy()).alias("__gw_n"), F.col("first"), F.col("last")]
    if spec.running_sum:
        cols.append(F.sum("s").over(before).alias("__gw_carry"))
    per = per.select(*cols, F.lag("last.t").over(w).alias("t_before"))
    goes_on = F.coalesce(F.col("first").eqNullSafe(F.col("t_before")) & (F.col("__gw_off") > 0), F.lit(False))
    # where the bucket's last tie group begins; unknown here (NULL) if the
    # whole bucket is one group that began earlier
    begins = F.when(F.col("last.__gw_rank") > 1, F.col("__gw_off") + F.col("last.__gw_rank")).otherwise(
        F.when(~goes_on, F.col("__gw_off") + 1))
    per = per.withColumn("goes_on", goes_on).withColumn("begins", begins)
    begins = F.last("begins", ignorenulls=True).over(so_far)
    per = per.withColumn("begins", begins)
    first_begins = F.when(F.col("goes_on"), F.lag("begins").over(w)).otherwise(F.col("__gw_off") + 1)
    out = per.withColumn("__gw_first", first_begins)
    return out.select(_B, "__gw_off", "__gw_n", "__gw_first", *(["__gw_carry"] if spec.running_sum else []))


def _apply(df: DataFrame, spec: GlobalSpec, buckets: int) -> DataFrame:
    columns = df.columns
    full = [*spec.order, *[asc(k) for k in (spec.keys or (_TIE,))]]
    if not spec.keys:  # a hash of the row breaks ties, so a hot value still spreads over buckets
        df = df.withColumn(_TIE, F.xxhash64(*columns))
    in_order = Window.partitionBy(_B).orderBy(*_spark_order(full))
    numbered = (bucketed(df, full, buckets)
                .withColumn(_RN, F.row_number().over(in_order).cast("bigint"))
                .withColumn(_RANK, F.rank().over(Window.partitionBy(_B).orderBy(*_spark_order(spec.order))).cast("bigint")))
    if spec.running_sum:
        numbered = numbered.withColumn(
            _SUM, F.sum(spec.running_sum[1]).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    numbered = numbered.checkpoint(eager=True)
    # one row per bucket: bounded by ``buckets``
    out = numbered.join(F.broadcast(_offsets(numbered, spec)), _B)
    rn = F.col(_RN) + F.col("__gw_off")
    added = {}
    if spec.row_number:
        added[spec.row_number] = rn
    if spec.rank:
        added[spec.rank] = F.when(F.col(_RANK) == 1, F.col("__gw_first")).otherwise(F.col(_RANK) + F.col("__gw_off"))
    if spec.running_sum:
        zero = F.lit(0).cast(numbered.schema[_SUM].dataType)
        total = F.coalesce(F.col(_SUM), zero) + F.coalesce(F.col("__gw_carry"), zero)
        added[spec.running_sum[0]] = F.when(F.col(_SUM).isNotNull() | F.col("__gw_carry").isNotNull(), total)
    if spec.ntile:
        name, k = spec.ntile
        q = F.floor(F.col("__gw_n") / k)
        r = F.col("__gw_n") - q * k
        big = r * (q + 1)
        added[name] = (F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1)
                       .otherwise(F.floor((rn - 1 - big) / F.greatest(q, F.lit(1))) + r + 1).cast("bigint"))
    return out.select(*[F.col(c) for c in columns if c not in added], *[c.alias(name) for name, c in added.items()])


def global_windows(df: DataFrame, specs: Sequence[GlobalSpec], *, buckets: int | None = None,
                   materialize: bool = True) -> DataFrame:
    """Add the outputs of several global windows to ``df``.  The input is
    checkpointed first (``materialize``), as the range partitioner samples it
    before it is shuffled."""
    if materialize:
        df = df.checkpoint(eager=True)
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for spec in specs:
        df = _apply(df, spec, buckets)
    return df


def global_window(df: DataFrame, order: Sequence[OrderKey], keys: Sequence[str] = (), *,
                  row_number: str | None = None, rank: str | None = None,
                  ntile: tuple[str, int] | None = None,
                  running_sum: tuple[str, str] | None = None,
                  buckets: int | None = None, materialize: bool = True) -> DataFrame:
    """One global window (see ``GlobalSpec`` and the module doc)."""
    spec = GlobalSpec(tuple(order), tuple(keys), row_number, rank, ntile, running_sum)
    return global_windows(df, [spec], buckets=buckets, materialize=materialize)


def global_rank(df: DataFrame, order: Sequence[OrderKey], name: str = "rank", **kw) -> DataFrame:
    return global_window(df, order, (), rank=name, **kw)


def global_row_number(df: DataFrame, order: Sequence[OrderKey], keys: Sequence[str],
                      name: str = "row_number", **kw) -> DataFrame:
    return global_window(df, order, keys, row_number=name, **kw)


def global_ntile(df: DataFrame, k: int, order: Sequence[OrderKey], keys: Sequence[str],
                 name: str = "ntile", **kw) -> DataFrame:
    return global_window(df, order, keys, ntile=(name, k), **kw)


def global_running_sum(df: DataFrame, column: str, order: Sequence[OrderKey], keys: Sequence[str],
                       name: str = "running_sum", **kw) -> DataFrame:
    return global_window(df, order, keys, running_sum=(name, column), **kw)
