"""Hard negatives by maximum inner product over cover trees.

For each anchor, its positives are the rows of the same label with the
highest inner products; for each positive, the negatives are the rows of
other labels that come highest among those whose inner product lies between
``low`` and ``high`` hundredths of the positive's.

1. Rows of one label and vector score alike, so only the smallest ids of
   each (one more than any list is long) can be named: the others are
   dropped by a group limit, before the shuffle.
2. Spark's range partitioner deals the rest out by dimension, label and a
   hash, so a label with a third of all rows is split; each task packs at
   most ``TREE_ROWS`` of them into a cover tree, and a checkpoint freezes
   the trees.
3. The distinct (label, vector) pairs of the anchors are the queries.  They
   go to all trees in blocks of at most about ``BLOCK`` queries, so what is
   broadcast or brought to the driver at once is bounded; a block first finds
   its positives, then the windows that follow from them.  Each tree gives
   its own first few; windows over (query) and (query, window) merge them.

Defined results: rows with a null label or vector, or with a null component,
take no part; a null id comes after all others; vectors of different lengths
never meet; repeated rows are rows of their own, an anchor is never its own
positive but an equal row may be; inner products are exact, those beyond 64
bits are returned as the nearest 64-bit value; no anchors or no rows give an
empty result.  Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.covertree import Tree
from basketry.llm.text import release_memory

POSITIVES = 5
NEGATIVES = 5
#: Distinct vectors of a tree.
TREE_ROWS = 8192
#: Queries sent to the trees at once.
BLOCK = 16_384
_MOST = (1 << 63) - 1

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def finite(vector: str) -> Column:
    """Whether the vector and all its components are there and finite."""
    inside = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(F.col(vector).isNotNull() & inside, F.lit(False))


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component, in doubles, as long."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def _build(rows: int) -> Callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = defaultdict(list)

        def tree(size: int) -> pa.RecordBatch:
            got = waiting.pop(size)
            labels, vectors, ids = zip(*got)
            points = np.array(vectors, dtype=np.int64).reshape(len(got), size)
            made = Tree.build(points, np.array(labels, dtype=np.int64), list(ids))
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([made.pack()], pa.binary())], ["size", "tree"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("size", "label", "vec", "ids"))
            for size, label, vec, ids in zip(*columns):
                # rows come in order of size, so few sizes wait at once
                for done in [s for s in waiting if s < size]:
                    yield tree(done)
                waiting[size].append((label, vec, [x["vec_id"] for x in ids]))
                if len(waiting[size]) >= rows:
                    yield tree(size)
        for size in list(waiting):
            yield tree(size)
    return build


def trees(rows: DataFrame, most_ids: int, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(size, tree) over all ``rows`` (vec_id, label, vec), checkpointed."""
    same = Window.partitionBy("label", "vec").orderBy(F.col("vec_id").asc_nulls_last())
    named = rows.select("vec_id", "label", "vec").withColumn("place", F.row_number().over(same)).where(F.col("place") <= most_ids)
    distinct = named.groupBy("label", "vec").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id"))).alias("ids"))
    distinct = distinct.withColumn("size", F.size("vec"))
    dealt = distinct.repartitionByRange("size", "label", F.xxhash64("vec")).sortWithinPartitions("size", "label")
    return dealt.select("size", "label", "vec", "ids").mapInArrow(_build(tree_rows), "size int, tree binary").checkpoint()


def _searching(queries, find: Callable, columns: list[str]) -> Callable:
    """A function of batches of trees: ``find(query on a tree, query row)``
    gives rows, led by the query's number."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = queries.value
        for batch in batches:
            for size, blob in zip(batch.column("size").to_pylist(), batch.column("tree").to_pylist()):
                tree, out = Tree.unpack(blob), []
                for row in wanted.get(size, ()):
                    out += [(row[0], *x) for x in find(tree.query(row[2]), row)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], columns)
        release_memory()
    return search


def _in_64(x: int) -> int:
    return max(-_MOST - 1, min(_MOST, x))


def _positives(k: int) -> Callable:
    def find(on, row):
        return [(_in_64(s), i) for s, i in on.search(k, row[1], True)] if _holds(on.tree, row[1]) else []
    return find


def _holds(tree: Tree, label: int) -> bool:
    return tree.low_label[0] <= label <= tree.high_label[0]


def _negatives(k: int, low: int, high: int) -> Callable:
    def find(on, row):
        if on.tree.low_label[0] == on.tree.high_label[0] == row[1]:
            return []
        out = []
        for p in row[3]:
            # low * p <= 100 * n <= high * p
            a, b = -(-low * p // 100), high * p // 100
            if a <= b:
                out += [(p, _in_64(s), i) for s, i in on.search(k, row[1], False, a, b)]
        return out
    return find


def _first(rows: DataFrame, by: list[str], k: int, place: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("found_id").asc_nulls_last())
    return rows.withColumn(place, F.row_number().over(order)).where(F.col(place) <= k)


def _block(forest: DataFrame, block: list, positives: int, negatives: int, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """Positives (one more than asked for, the anchor itself included) and
    negatives of one block of queries; both checkpointed."""
    context = forest.sparkSession.sparkContext

    def ask(rows: dict, find: Callable, columns: list[str]) -> tuple:
        shared = context.broadcast(rows)
        return shared, forest.mapInArrow(_searching(shared, find, columns), ", ".join(f"{c} long" for c in columns))

    by_size: dict[int, list] = defaultdict(list)
    for qid, label, vec in block:
        by_size[len(vec)].append((qid, label, np.array(vec, dtype=np.int64)))
    shared, near = ask(dict(by_size), _positives(positives + 1), ["qid", "score", "found_id"])
    near = _first(near, ["qid"], positives + 1, "place").checkpoint()
    shared.destroy()
    windows: dict[int, set] = defaultdict(set)
    for qid, score in near.select("qid", "score").collect():  # at most BLOCK * (positives + 1)
        windows[qid].add(score)
    asked = {size: [(*row, sorted(windows[row[0]], reverse=True)) for row in rows] for size, rows in by_size.items()}
    shared, far = ask(asked, _negatives(negatives, low, high), ["qid", "positive_score", "score", "found_id"])
    far = _first(far, ["qid", "positive_score"], negatives, "rank").checkpoint()
    shared.destroy()
    return near, far


def mine(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", vec: str = "vec", label: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 80, high: int = 100,
         tree_rows: int = TREE_ROWS, block: int = BLOCK) -> DataFrame:
    """The hard negatives of the rows where ``anchor`` holds; ``vec`` is an
    array of whole numbers."""
    spark = rows.sparkSession
    usable = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                         F.col(vec).cast("array<long>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    usable = usable.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull()))
    anchors = usable.where("anchor").select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vec").checkpoint()
    queries = anchors.select("label", "vec").distinct().withColumn("qid", F.monotonically_increasing_id()).checkpoint()
    blocks = math.ceil(queries.count() / block)
    if not blocks:
        return spark.createDataFrame([], RESULT)
    forest = trees(usable, max(positives + 1, negatives), tree_rows)
    part = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    found = [_block(forest, queries.where(part == i).select("qid", "label", "vec").collect(), positives, negatives, low, high)
             for i in range(blocks)]
    near, far = (reduce(DataFrame.union, x) for x in zip(*found))

    # an anchor is taken out of its own list once
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    mine_ = anchors.join(queries, ["label", "vec"]).select("row", F.col("vec_id").alias("anchor_id"), "qid", square.alias("square"))
    pairs = mine_.join(near.select("qid", "score", "found_id", "place"), "qid")
    # its own score is its square: exact in doubles below 2**53
    apart = F.abs(F.col("score") - F.col("square"))
    own = F.col("found_id").eqNullSafe(F.col("anchor_id")) & (apart <= F.when(F.col("square") < 2.0 ** 53, 0.0).otherwise(F.col("square") * 1e-9))
    own = F.min(F.when(own, F.col("place"))).over(Window.partitionBy("row"))
    pairs = pairs.withColumn("own", own).where(~F.col("place").eqNullSafe(F.col("own")))
    pairs = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("row").orderBy("place"))).where(F.col("nth") <= positives)
    pairs = pairs.select("anchor_id", F.col("found_id").alias("positive_id"), "qid", F.col("score").alias("positive_score"))
    out = pairs.join(far.withColumnsRenamed({"score": "negative_score", "found_id": "negative_id"}), ["qid", "positive_score"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
