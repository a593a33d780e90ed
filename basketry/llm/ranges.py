"""Cutting a table into ranges of an integer key of about equal row counts.

The cut points are real key values (quantiles computed by Spark); their
number follows the bytes of text, so a range holds about ``range_bytes`` if
long texts lie evenly over the keys.  ``byte_cuts`` cuts by the bytes
themselves, for users that hold a range in memory.  ``range_of`` is a native
expression: it searches a list of lists of cut points, so it compares about
2*sqrt(n) values a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Text bytes of a range.  Raise it towards 256 MB on inputs of many TB: a
#: range is the unit that one Python worker holds.
RANGE_BYTES = 8 << 20
#: Bytes that a row counts beside its text, so that short texts are bounded too.
ROW_BYTES = 64


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of UTF-8 in a text column (one scan of that column)."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def cut_points(docs: DataFrame, key: str, n: int) -> list[int]:
    """At most n ascending distinct key values; the first is the smallest key.
    Empty if the table has no key that is not null."""
    n = max(1, n)
    steps = [i / n for i in range(n)]
    row = docs.agg(F.min(key).alias("low"), F.percentile_approx(key, steps, max(10_000, 20 * n)).alias("cuts")).first()
    if row["low"] is None:
        return []
    return sorted({row["low"], *row["cuts"]})


def byte_cuts(docs: DataFrame, key: str, text: str = "text", range_bytes: int = RANGE_BYTES) -> tuple[list[int], dict[int, int]]:
    """Cuts of ranges of at most 2 * range_bytes of rows (text and ROW_BYTES
    each), from exact running sums in order of the key; and the keys whose
    rows alone exceed range_bytes, with the number of pieces they need.  Such
    a key is a range by itself."""
    weight = F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES)
    sizes = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(weight.alias("bytes"))
    # parts ascend with the key; the checkpoint keeps each row in its part
    sizes = sizes.repartitionByRange("key").withColumn("part", F.spark_partition_id()).checkpoint()

    def before(column: str, w) -> Column:
        return F.coalesce(F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("bytes").alias("n"))
    parts = parts.select("part", before("n", Window.partitionBy().orderBy("part")).alias("offset"))
    start = F.col("offset") + before("bytes", Window.partitionBy("part").orderBy("key"))
    placed = sizes.join(F.broadcast(parts), "part").withColumn("slot", F.floor(start / range_bytes))
    # a heavy key ends its slot, so the next key begins another one
    heavy = F.when(F.col("bytes") > range_bytes, F.col("key"))
    cuts = placed.groupBy("slot", heavy.alias("heavy")).agg(F.min("key").alias("low"), F.max("bytes").alias("bytes")).collect()
    return sorted(r["low"] for r in cuts), {r["heavy"]: math.ceil(r["bytes"] / range_bytes) for r in cuts if r["heavy"] is not None}


class Ranges:
    """The ranges [cut i, cut i+1) of a key."""

    def __init__(self, cuts: list[int]):
        self.cuts = cuts
        self.count = max(1, len(cuts))
        self.stride = max(1, math.isqrt(len(cuts)))

    def _nested(self) -> tuple[str, str]:
        groups = [self.cuts[i:i + self.stride] for i in range(0, len(self.cuts), self.stride)]

        def listed(values):
            return "array(" + ",".join(f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")"
        return f"array({','.join(map(listed, groups))})", listed(g[0] for g in groups)

    def range_of(self, key: str) -> Column:
        """0-based range of a key that is not null."""
        if not self.cuts:
            return F.lit(0)
        groups, heads = self._nested()
        group = f"greatest(size(filter({heads}, h -> h <= `{key}`)), 1)"
        inner = f"size(filter(element_at({groups}, {group}), c -> c <= `{key}`))"
        return F.expr(f"CAST(({group} - 1) * {self.stride} + greatest({inner}, 1) - 1 AS INT)")

    def starts_range(self, key: str) -> Column:
        """Whether the key is the first of its range."""
        if not self.cuts:
            return F.lit(False)
        groups, heads = self._nested()
        group = f"greatest(size(filter({heads}, h -> h <= `{key}`)), 1)"
        return F.expr(f"array_contains(element_at({groups}, {group}), `{key}`)")


def ranges_for(docs: DataFrame, key: str, text: str = "text", range_bytes: int = RANGE_BYTES) -> Ranges:
    return Ranges(cut_points(docs, key, math.ceil(text_bytes(docs, text) / range_bytes)))
