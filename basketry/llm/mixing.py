"""Mixing sources to target weights by systematic sampling, in DataFrame
operations only.

Size of a document: its words.  Sources in code-point order (null last) weigh
1, 2, 3, repeating, and share all words; a source's target stops at ``most``
times its size and the excess is shared again by weight until none is above
(water level: target = min(cap, level * weight)).  Every document of a source
expects r = target / source size copies.  Documents stand in an order, their
expected copies are summed from the left, one random offset u of the source
is added, and a document is emitted once for each integer boundary that its
interval [u + r*k, u + r*(k+1)) crosses: floor(r) or ceil(r) times.

The order: size class (sixteen to an octave), then an md5 of id and text.
Neighbours are alike in size, so what the mix takes stays within a document or two of the
target for each class.  The rank k comes in three steps, each bounded: the
classes of a source, the hash cells of a class, the rows of a cell.  The
cells are so many that one holds about ``CELL_ROWS`` rows even if all rows
are of one class of one source.

Defined results: null text has size 0; a source of size 0 has target 0 and
none of its documents is taken; rows that agree in id and text have copies
that differ by one at most and are interchangeable; null ids are allowed.
An input column named like an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: No target above this many times its source's size.
MOST = 3
#: Expected rows of the largest cell.
CELL_ROWS = 10_000
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target; one row a source.

    The water level: with sources in order of cap / weight, the first whose
    cap is not reached by the level that remains for it and those after it
    fixes the level for all of them."""
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last()))
    w = sizes.withColumn("w", ((rank - 1) % 3 + 1).cast("bigint")).withColumn("cap", F.col("source_size") * most)
    rising = Window.partitionBy().orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    w = w.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    level = F.col("left") / F.col("w_left")
    w = w.withColumn("level", F.when(F.col("cap") >= level * F.col("w"), level))
    level = F.first("level", ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    w = w.withColumn("water", level)
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("w"))
    return w.select("source", "source_size", target.cast("double").alias("target"))


def _unit(hexadecimal: Column) -> Column:
    """The first eight hexadecimal digits as a fraction in [0, 1)."""
    return F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def size_class(size: str = "size") -> Column:
    """Sizes below 32 each by itself, then 16 classes an octave: the shift
    that leaves five binary digits, and those digits.  Integers only."""
    shift = f"greatest(length(bin({size})) - 5, 0)"
    return F.expr(f"CAST({shift} * 16 + shiftright({size}, {shift}) AS INT)")


def with_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
                keep: list[str] | None = None, most: int = MOST, seed: str = SEED,
                cell_rows: int = CELL_ROWS) -> DataFrame:
    """``docs`` (all columns, or ``keep``) with size, source_size, target,
    copies and taken = copies * size."""
    kept = docs.columns if keep is None else keep
    own = {"size", "source_size", "target", "copies", "taken"}
    named = [F.col(c).alias(f"c_{c}") for c in kept if c not in own]
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
    rows = docs.select(*named, F.col(source).alias("source"), size_of(F.col(text)).alias("size"), key.alias("key"))
    rows = rows.withColumn("class", size_class("size"))
    n = docs.count()
    cells = max(1, n // cell_rows)
    rows = rows.withColumn("cell", F.floor(_unit(F.col("key")) * cells).cast("int"))

    # rows and words of each cell, then of each class, then of each source
    counts = rows.groupBy("source", "class", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).checkpoint()
    in_class = Window.partitionBy("source", "class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    in_source = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = counts.groupBy("source", "class").agg(F.sum("n").alias("n"))
    classes = classes.select("source", "class", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("before_class"))
    shares = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), most)
    starts = counts.select("source", "class", "cell", F.coalesce(F.sum("n").over(in_class), F.lit(0)).alias("before_cell"))

    def on(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        right = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
        return left.join(right, same, "inner").drop(*[f"r_{k}" for k in keys])

    starts = on(on(starts, classes, "source", "class"), shares, "source")
    starts = starts.withColumn("before", F.col("before_class") + F.col("before_cell")).drop("before_class", "before_cell")
    rows = on(rows, starts, "source", "class", "cell")
    order = Window.partitionBy("source", "class", "cell").orderBy("key")
    k = F.col("before") + F.row_number().over(order) - 1
    u = _unit(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit("")))))
    r = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rows = rows.withColumn("k", k.cast("double"))
    copies = (F.floor(u + r * (F.col("k") + 1)) - F.floor(u + r * F.col("k"))).cast("bigint")
    rows = rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select(*[F.col(f"c_{c}").alias(c) for c in kept if c not in own],
                       "size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as many times as it was emitted,
    with the columns of ``docs``."""
    order = docs.columns
    apart = docs.withColumnsRenamed({c: f"d_{c}" for c in order})
    options = {k: f"d_{options.get(k, k)}" for k in ("text", "doc_id", "source")} | {k: v for k, v in options.items() if k not in ("text", "doc_id", "source")}
    copied = with_copies(apart, **options)
    # a document that stays out has no copy to make a row of
    out = copied.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, CAST(copies AS INT))")))
    return out.select(*[F.col(f"d_{c}").alias(c) for c in order])
