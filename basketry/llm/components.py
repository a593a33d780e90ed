"""Connected components of a link table by alternating large-star and
small-star steps, all in joins and aggregates.

Every step replaces links by links to smaller nodes; components never
change, and when a round changes nothing each node is linked to the smallest
node of its component.  Rounds grow with the logarithm of the component
size, not with its diameter.  A hub's links are never gathered in one place:
its smallest neighbour comes from a map-side combined min, and the join back
is an ordinary equi-join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(links: DataFrame) -> DataFrame:
    """For links (a, b): link every b to the smallest node next to a (a
    itself included) when that node is smaller."""
    least = links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return links.join(least, "a")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link to another node; root is the
    smallest node that can be reached.  Null ends and links of a node to
    itself say nothing and are left out.  No links: an empty table."""
    x = F.greatest(a, b)
    y = F.least(a, b)
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = links.select(x.alias("a"), y.alias("b")).distinct().checkpoint()

    def state(df: DataFrame):
        return tuple(df.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: each node and its smaller neighbours go to the smallest of them
        small = _star(large.distinct())
        links = (
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b")))
            .distinct().checkpoint()
        )
        after = state(links)
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
