"""Ranked lexical search for many queries at once, by common subexpressions.

A document's score for an item is a sum over the item's terms, so items that
share terms share parts of their sums.  ``Plan`` mines these shared term
sets: terms that occur in the same items become one node; then, round by
round, pairs of nodes that several items hold become a node of their own in
all of them.  The result is a graph in which every node is the sum of two
others (or of a set of terms) and an item is the sum of what is left to it.

1. One pass over the texts keeps, for each document, its length and how often
   the terms asked for occur (an Arrow function; a checkpoint holds them).
2. Spark sums the number of documents N, of terms L and the documents of each
   term; weights follow.
3. One pass over the checkpoint: for a slice of documents each node's partial
   scores are materialised once, as one array, and combined along the graph;
   a task keeps the ``k`` best of each item.
4. A window over the item ranks what the tasks kept.

Items are taken in blocks of at most about ``BLOCK_WORDS`` words, so what is
broadcast is bounded; more items make more passes, each of which ends in a
checkpoint before its broadcasts go.

Scores are 64-bit integers throughout.  Defined results: null text has no
terms; an item without terms, or whose terms occur nowhere, has no rows; equal
scores rank by doc_id, null last; repeated documents and repeated items rank
as rows of their own; empty tables give an empty result; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.text import LOWER_ALNUM, as_bytes, release_memory, words

#: Documents returned for each item.
BEST = 50
#: Words of items in one pass.
BLOCK_WORDS = 500_000
#: Partial scores (8 bytes each) that a task holds at once.
CELLS = 2_000_000
#: A document's id, which may be missing.
ID = np.dtype([("none", bool), ("id", np.int64)])
RESULT = "item_id long, rank int, doc_id long, score long"


def terms(raw: bytes | None) -> list[bytes]:
    """Maximal runs of letters, digits and bytes beyond ASCII, A-Z lower-cased."""
    return words(raw.translate(LOWER_ALNUM)) if raw else []


@dataclass
class Plan:
    """Node i < len(sets) is the sum of the terms ``sets[i]``; node
    len(sets) + j the sum of the two nodes ``pairs[j]``; item number i the
    sum of the nodes ``items[i]``."""

    sets: list[list[int]] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    items: list[list[int]] = field(default_factory=list)

    @classmethod
    def share(cls, items: list[set[int]]) -> Plan:
        holders: dict[int, list[int]] = defaultdict(list)
        for i, item in enumerate(items):
            for t in item:
                holders[t].append(i)
        alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for t in sorted(holders):
            alike[tuple(holders[t])].append(t)
        plan = cls(sets=list(alike.values()))
        held: list[set[int]] = [set() for _ in items]
        support = []
        for node, of in enumerate(alike):
            support.append(len(of))
            for i in of:
                held[i].add(node)
        while True:
            # neighbours in the order of their support: as many pairs as nodes
            near: Counter = Counter()
            for nodes in held:
                shared = sorted((x for x in nodes if support[x] > 1), key=lambda x: (-support[x], x))
                near.update(zip(shared, shared[1:]))
            used: set[int] = set()
            chosen = []
            for (a, b), n in sorted(near.items(), key=lambda x: (-x[1], x[0])):
                if n > 1 and a not in used and b not in used:
                    used |= {a, b}
                    chosen.append((a, b))
            if not chosen:
                break
            partner = {a: (b, len(support) + j) for j, (a, b) in enumerate(chosen)}
            plan.pairs += chosen
            support += [0] * len(chosen)
            for nodes in held:
                for a in [x for x in nodes if x in partner]:
                    b, both = partner[a]
                    if b in nodes:
                        nodes -= {a, b}
                        nodes.add(both)
                        support[both] += 1
        plan.items = [sorted(x) for x in held]
        return plan

    def additions(self) -> int:
        """Sums of two arrays that a slice of documents costs."""
        return sum(len(s) for s in self.sets) + len(self.pairs) + sum(map(len, self.items))


class Ranker:
    """The best documents of each item among those a task has met."""

    def __init__(self, plan: Plan, weights: np.ndarray, n: int, length: int, k: int, cells: int = CELLS):
        self.plan, self.weights, self.n, self.length, self.k = plan, weights, n, length, k
        self.rows = max(64, cells // max(1, len(plan.sets) + len(plan.pairs)))
        nobody = np.empty(0, dtype=ID)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), nobody) for _ in plan.items]
        # a node goes as soon as the last that needs it has it
        self.needed = Counter(x for pair in plan.pairs for x in pair) + Counter(x for nodes in plan.items for x in nodes)

    def add(self, ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Documents with their ids (``ID``) and lengths; entries (document's
        place, term, occurrences), in order of their document."""
        edges = np.searchsorted(doc, np.arange(0, len(ids) + self.rows, self.rows))
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            at = slice(i * self.rows, (i + 1) * self.rows)
            self._slice(ids[at], lengths[at], doc[a:b] - at.start, term[a:b], tf[a:b])

    def _slice(self, ids, lengths, doc, term, tf) -> None:
        if not len(doc):
            return
        m = 100 - 50 + (50 * lengths * self.n) // self.length
        score = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        order = np.argsort(term, kind="stable")
        doc, term, score = doc[order], term[order], score[order]
        present, starts = np.unique(term, return_index=True)
        of_term = {t: slice(a, b) for t, a, b in zip(present.tolist(), starts.tolist(), [*starts[1:].tolist(), len(term)])}
        plan, needed, partial = self.plan, dict(self.needed), {}

        def take(node: int) -> np.ndarray | None:
            needed[node] -= 1
            return partial.get(node) if needed[node] else partial.pop(node, None)

        for node, members in enumerate(plan.sets):
            for t in members:
                at = of_term.get(t)
                if at is not None:
                    if node not in partial:
                        partial[node] = np.zeros(len(ids), dtype=np.int64)
                    partial[node][doc[at]] += score[at]  # a document has a term once
        for j, (a, b) in enumerate(plan.pairs):
            x, y = take(a), take(b)
            if x is not None or y is not None:
                partial[len(plan.sets) + j] = x if y is None else y if x is None else x + y
        for i, nodes in enumerate(plan.items):
            total = None
            for x in map(take, nodes):
                if x is not None:
                    total = x if total is None else total + x
            if total is not None:
                self._keep(i, total, ids)

    def _keep(self, i: int, total: np.ndarray, ids: np.ndarray) -> None:
        scores, docs = self.best[i]
        least = scores[-1] if len(scores) == self.k else 1
        at = np.flatnonzero(total >= max(least, 1))
        if len(at) > self.k:  # all that tie with the k-th stay
            at = at[total[at] >= np.partition(total[at], len(at) - self.k)[len(at) - self.k]]
        if not len(at):
            return
        scores, docs = np.concatenate((scores, total[at])), np.concatenate((docs, ids[at]))
        order = np.lexsort((docs["id"], docs["none"], -scores))[:self.k]
        self.best[i] = scores[order], docs[order]


def _counting(vocabulary):
    @F.arrow_udf("struct<n:long,terms:array<int>,tf:array<int>>")
    def count(text: pa.Array) -> pa.Array:
        known, n, offsets, found, times = vocabulary.value, [], [0], [], []
        for raw in as_bytes(text):
            got = terms(raw)
            n.append(len(got))
            for t, tf in Counter(x for x in map(known.get, got) if x is not None).items():
                found.append(t)
                times.append(tf)
            offsets.append(len(found))
        ends = pa.array(offsets, pa.int32())
        release_memory()
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())),
                                           pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))], ["n", "terms", "tf"])
    return count


def _ranking(shared):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights, n, length, k, item_ids = shared.value
        ranker = Ranker(plan, weights, n, length, k)
        for batch in batches:
            found, tf = batch.column("terms"), batch.column("tf")
            counts = np.diff(found.offsets.to_numpy())
            ids = np.empty(batch.num_rows, dtype=ID)
            ids["none"] = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids["id"] = batch.column("doc_id").fill_null(0).to_numpy()
            ranker.add(ids, batch.column("n").to_numpy(), np.repeat(np.arange(batch.num_rows), counts), found.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64))
        for i, (scores, docs) in enumerate(ranker.best):
            if len(scores):
                known = [None if none else x for none, x in zip(docs["none"].tolist(), docs["id"].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(scores), pa.int32()), pa.array([item_ids[i]] * len(scores), pa.int64()),
                     pa.array(known, pa.int64()), pa.array(scores, pa.int64())], ["item", "item_id", "doc_id", "score"])
        release_memory()
    return rank


def _blocks(items: DataFrame, most: int) -> list[DataFrame]:
    """The items in parts of at most about ``most`` words (one item at least)."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = math.ceil(size / (2 * most)) or 1  # a term and its gap are two bytes at least
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [items.where(part == i) for i in range(parts)] if parts > 1 else [items]


def _pass(docs: DataFrame, block: DataFrame, k: int) -> DataFrame | None:
    context = docs.sparkSession.sparkContext
    rows = [(r[0], set(terms((r[1] or "").encode()))) for r in block.collect()]  # bounded by the block
    rows = [(i, t) for i, t in rows if t]
    number = {t: j for j, t in enumerate(sorted(set().union(*(t for _, t in rows))))} if rows else {}
    if not number:
        return None
    vocabulary = context.broadcast(number)
    counted = docs.withColumn("found", _counting(vocabulary)(F.col("text")))
    counted = counted.where("found.n > 0").select("doc_id", "found.n", "found.terms", "found.tf").checkpoint()
    vocabulary.destroy()
    n, length = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n:
        return None
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = np.zeros(len(number), dtype=np.int64)
    for term, held in holding.collect():  # one row a term of the block
        df[term] = held
    weights = np.where(df > 0, np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))), 0).astype(np.int64)
    # terms that weigh nothing, or occur nowhere, leave every sum as it is
    items = [{j for x in t if weights[j := number[x]] > 0} for _, t in rows]
    shared = context.broadcast((Plan.share(items), weights, n, length, k, [i for i, _ in rows]))
    found = counted.where(F.size("terms") > 0).mapInArrow(_ranking(shared), "item int, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    best = best.select("item_id", "rank", "doc_id", "score").checkpoint()
    shared.destroy()
    return best


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", k: int = BEST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    found = [x for block in _blocks(items, block_words) if (x := _pass(docs, block, k)) is not None]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], RESULT)
