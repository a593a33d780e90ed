"""Recursion that returns rows: links followed level by level, and the best
chains of steps through time.

``reach`` is a bounded WITH RECURSIVE: each level is one keyed join of the
rows found last with the links, rows that were found twice on a level are
merged, and a reliable checkpoint a level keeps the plan short and survives a
lost executor.  No level is larger than the distinct (carried columns, node)
pairs, however many ways lead to a node.

``best_chains`` answers the journey's question, chains of steps at strictly
rising times, without a row per chain: the best chain of k steps that ends at
a time extends the best chain of k - 1 steps that ended before, which is a
running minimum.  A key that holds a third of all steps has one row for each
of its times (days), and the windows share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.materialize import materialize


def reach(seed: DataFrame, links: DataFrame, node: Sequence[str], depth: int) -> DataFrame:
    """The rows of ``seed`` (depth 1) and those reached from them over
    ``links``, to ``depth`` rows in a chain: the columns of ``seed``, and depth.

    ``links`` has the ``node`` columns and next_<column> for each; the other
    columns of ``seed`` are carried along.  Cycles end at ``depth``; a null
    node has no links; equal rows of one depth are one row."""
    carried = [c for c in seed.columns if c not in node]
    following = [f"next_{c}" for c in node]
    links = materialize(links.select(*node, *following).distinct())
    level = materialize(seed.distinct())
    levels = [level.withColumn("depth", F.lit(1))]
    for k in range(2, depth + 1):
        found = level.join(links, list(node)).select(*carried, *[F.col(f).alias(c) for f, c in zip(following, node)])
        level = materialize(found.distinct())
        if level.isEmpty():
            break
        levels.append(level.withColumn("depth", F.lit(k)))
    return reduce(DataFrame.unionByName, levels)


def best_chains(steps: DataFrame, key: str, at: str, id_: str, value: str, starts: str, depth: int) -> DataFrame:
    """(key, length, total, path): for each key and each length up to
    ``depth``, the chain of steps with strictly rising ``at``, beginning with
    a step marked ``starts``, whose values add up highest; of equal totals the
    one with the smallest path (ids in order).

    Steps with a null value, time or key are in no chain.  Lengths that no
    chain of a key has are left out."""
    step = F.struct((-F.col(value)).alias("cost"), F.col(id_).alias("id"))
    # of a time's steps only the best can end or continue a best chain
    days = (steps.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull())
            .groupBy(key, at).agg(F.min(step).alias("step"), F.min(F.when(F.col(starts), step)).alias("start")))
    earlier = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    chains = days.withColumn("c1", F.when(F.col("start").isNotNull(), F.struct("start.cost", F.array("start.id").alias("path"))))
    for k in range(2, depth + 1):
        before = F.min(f"c{k - 1}").over(earlier)
        longer = F.struct((F.col("before.cost") + F.col("step.cost")).alias("cost"),
                          F.concat("before.path", F.array("step.id")).alias("path"))
        chains = (chains.withColumn("before", before)
                  .withColumn(f"c{k}", F.when(F.col("before").isNotNull(), longer)).drop("before"))
    best = chains.groupBy(key).agg(*[F.min(f"c{k}").alias(f"c{k}") for k in range(1, depth + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("length"), (-F.col(f"c{k}.cost")).alias("total"), F.col(f"c{k}.path").alias("path"))
                     for k in range(1, depth + 1)])
    return best.select(key, F.inline(rows)).where(F.col("path").isNotNull())
