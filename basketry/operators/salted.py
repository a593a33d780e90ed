"""Joining a fact to a dimension where some keys may be hot.

``hot_keys`` finds the keys that hold a notable share of the rows by Spark's
mergeable top-k sketch, in one scan of one column.  ``salted_join`` spreads
the fact's rows of these keys over several parts by another column and gives
the dimension a copy of their rows for each part; all other rows, and all
rows of a table without hot keys, are joined plainly.  Spark still broadcasts
the dimension where its size allows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with this share of the rows is hot; at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.01


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE) -> dict:
    """Key -> its share of the rows, for keys that hold ``share`` or more.
    Null keys join with nothing and are left out."""
    most = math.ceil(1 / share)
    found = rows.agg(F.expr(f"approx_top_k(`{key}`, {most}, {100 * most})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return {x["item"]: x["count"] / found["n"] for x in found["top"] or () if x["item"] is not None and x["count"] >= share * found["n"]}


def salted_join(fact: DataFrame, dimension: DataFrame, key: str, spread_by: str, hot: dict | None = None) -> DataFrame:
    """Inner join on ``key``; rows of the ``hot`` keys (with their shares)
    are spread by ``spread_by`` over as many parts as a key with that share
    would fill of the session's shuffle partitions.  Without ``hot`` they are
    looked for in the fact itself."""
    if hot is None:
        hot = hot_keys(fact, key)
    if not hot:
        return fact.join(dimension, key)
    partitions = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(2, math.ceil(max(hot.values()) * partitions))
    is_hot = F.col(key).isin(list(hot))  # at most 1 / HOT_SHARE keys
    spread = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    left = fact.withColumn("__salt", F.when(is_hot, spread).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(dimension.withColumn("__salt", F.explode(copies)), [key, "__salt"]).drop("__salt")
