"""Exact distinct counts that merge: the ids of a group as bitmaps.

Spark's bitmaps hold 32,768 neighbouring ids each (4 KB).  Ids are made
distinct first and then brought together by group and bitmap, so each bitmap
is built once, by one task, whatever the order of the rows; bitmaps of months
merge to years by OR, without the rows.  For whole-number ids that lie
reasonably close; other ids need a two-level distinct count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def countable(rows: DataFrame, id_: str) -> bool:
    return isinstance(rows.schema[id_].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def id_bitmaps(rows: DataFrame, groups: Sequence[str], id_: str) -> DataFrame:
    """(groups, bucket, bitmap): one row for each bitmap that has an id.
    Null ids are not counted."""
    ids = rows.where(F.col(id_).isNotNull()).select(*groups, F.col(id_).cast("long").alias("__id")).distinct()
    placed = ids.select(*groups, F.bitmap_bucket_number("__id").alias("bucket"), F.bitmap_bit_position("__id").alias("__bit"))
    return placed.repartition(*groups, "bucket").groupBy(*groups, "bucket").agg(F.bitmap_construct_agg("__bit").alias("bitmap"))


def merged(bitmaps: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The bitmaps of coarser groups (columns of ``bitmaps``, or none)."""
    return bitmaps.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def distinct_counts(bitmaps: DataFrame, groups: Sequence[str], name: str = "n") -> DataFrame:
    """Distinct ids of each group; ``bitmaps`` has one row a group and bucket."""
    return bitmaps.groupBy(*groups).agg(F.sum(F.bitmap_count("bitmap")).cast("bigint").alias(name))
