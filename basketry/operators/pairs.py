"""Co-occurrence pairs: for each unordered pair (a < b) of items, how many
entities hold both; plus how many entities hold each item.

The input is the distinct (entity, item) table.  Pairs are an equi self join
on the entity with ``a < b``, counted per task before they are shuffled, so
no array of pairs and no list of an entity's items is ever built.  Its rows
are those of the question itself: every pair that an entity holds.  This is
meant for items that an entity holds few of (categories, brands), as in the
reference's cross-sell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(held: DataFrame, entity: str, item: str, a: str = "item_a", b: str = "item_b",
                both: str = "both") -> DataFrame:
    """(a, b, both) from distinct (entity, item); null items pair with none."""
    left = held.select(entity, F.col(item).alias(a))
    right = held.select(entity, F.col(item).alias(b))
    return left.join(right, entity).where(F.col(a) < F.col(b)).groupBy(a, b).agg(F.count(F.lit(1)).alias(both))


def item_counts(held: DataFrame, item: str, name: str = "item", holders: str = "holders") -> DataFrame:
    """(item, holders) from distinct (entity, item)."""
    held = held.where(F.col(item).isNotNull())
    return held.groupBy(F.col(item).alias(name)).agg(F.count(F.lit(1)).alias(holders))
