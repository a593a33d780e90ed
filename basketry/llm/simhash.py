"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at
``MOST_BITS`` differing bits or fewer, and their connected components.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of
``SHINGLE`` consecutive words joined by a space, repeats included (fewer
words: the whole sequence).  A bit is 1 if it is set in more than half of
the shingles' XXH64 values (seed 42).  Null text and text without words have
fingerprint zero and are linked like any other.

Links come from an inverted index on byte positions with a count filter.  Two
fingerprints that differ in at most 3 bits agree in at least 5 of their 8
bytes, position by position: 5 is the guaranteed number of matches.  A plain
index (position, byte) would put 1/256 of all documents in one posting, so
its postings are kept in intersected form: one posting for each 5 positions
and their bytes (56 for a fingerprint).  Two fingerprints meet in a posting
exactly when their tally of shared positional bytes is 5 or more, so meeting
is the count filter, and the pair is then verified on its bits.

Sizes: equal fingerprints are one entry, so copies cost nothing.  A posting
fixes 40 of 64 bits and therefore has at most 2**24 entries, whatever the
data; it is read as a sorted stream, and its neighbours are found either
entry against entry or by looking up the 2,324 ways to flip up to 3 of its 24
free bits, whichever is shorter.  A posting gives links that span its
components, never its pairs: at most one link for each entry.

Defined results: rows that agree in doc_id and text are one document to
``keep_first`` (one row stays); null doc_ids count as larger than any id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.components import components
from basketry.llm.text import LOWER, as_bytes, release_memory, words

SHINGLE = 3
MOST_BITS = 3
SEED = 42
#: Shared positional bytes that 3 differing bits always leave.
SHARED = 8 - MOST_BITS
#: The byte positions of each posting, as masks on the fingerprint.
MASKS = [sum(0xFF << (8 * p) for p in positions) for positions in combinations(range(8), SHARED)]
_FREE = 64 - 8 * SHARED
#: Every way to flip 1 to 3 of the free bits of a posting.
FLIPS = np.array([sum(1 << b for b in bits) for n in range(1, MOST_BITS + 1) for bits in combinations(range(_FREE), n)], dtype=np.uint32)


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    tokens = words(raw.translate(LOWER)) if raw else []
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1)
    starts = [0, *ends[:n - 1].tolist()]
    ends = (ends[min(shingle, len(tokens)) - 1:] - 1).tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), dtype=np.uint64, count=n)
    set_in = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        part = hashes[i:i + 65536]
        set_in += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: str, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a (signed) long."""
    def prints(column: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(raw, shingle) for raw in as_bytes(column)), dtype=np.uint64, count=len(column))
        release_memory()
        return pa.array(found.view(np.int64))
    return F.arrow_udf(prints, "bigint")(F.col(text))


def as_hex(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _labels(values: np.ndarray, mask: int) -> np.ndarray:
    """For the sorted distinct entries of a posting: index of the smallest
    entry of each one's component at MOST_BITS or fewer bits."""
    m = len(values)
    label = np.arange(m)
    if m <= min(len(FLIPS), 1024):
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= MOST_BITS
        def least():
            return np.where(near, label[None, :], m).min(axis=1)
    else:
        free = [p for p in range(8) if not mask >> (8 * p) & 0xFF]
        low = sum(((values >> np.uint64(8 * p)) & np.uint64(0xFF)) << np.uint64(8 * i) for i, p in enumerate(free)).astype(np.uint32)
        place = np.full(1 << _FREE, -1, dtype=np.int32)
        place[low] = np.arange(m)

        def least():
            found = label.copy()
            for flip in FLIPS:
                at = place[low ^ flip]
                np.minimum(found, label[at], out=found, where=at >= 0)
            return found
    while True:
        smaller = least()
        smaller = smaller[smaller]
        if np.array_equal(smaller, label):
            return label
        label = smaller


class _Forest:
    """What a task has linked so far: says whether a link is news.  Forgets
    all at a million entries, which may repeat links but loses none."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(p, p)
        return x

    def joins(self, a: int, b: int) -> bool:
        if len(self.parent) > 1_000_000:
            self.parent.clear()
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.parent.setdefault(min(a, b), min(a, b))
        return a != b


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that span the components of each posting of a stream sorted by
    (posting, fingerprint)."""
    masks = np.array(MASKS, dtype=np.uint64)
    forest = _Forest()
    kept_c, kept_f = np.empty(0, np.int32), np.empty(0, np.uint64)

    def found(c: np.ndarray, f: np.ndarray) -> Iterator[tuple[int, int]]:
        key = f & masks[c]
        new = np.flatnonzero((c[1:] != c[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate(([0], new))
        ends = np.concatenate((new, [len(f)]))
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            values = f[a:b]
            label = _labels(values, MASKS[c[a]])
            own = np.flatnonzero(label != np.arange(len(label)))
            for x, y in zip(values[own].view(np.int64).tolist(), values[label[own]].view(np.int64).tolist()):
                if forest.joins(x, y):
                    yield x, y

    def batch(links) -> pa.RecordBatch:
        links = list(links)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    for part in batches:
        if not part.num_rows:
            continue
        c = np.concatenate((kept_c, part.column("c").to_numpy(zero_copy_only=False)))
        f = np.concatenate((kept_f, part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
        key = f & masks[c]
        whole = np.flatnonzero((c != c[-1]) | (key != key[-1]))
        cut = whole[-1] + 1 if len(whole) else 0  # the last posting may go on in the next batch
        kept_c, kept_f = c[cut:], f[cut:]
        if cut:
            yield batch(found(c[:cut], f[:cut]))
    if len(kept_f):
        yield batch(found(kept_c, kept_f))


def links(fingerprints: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b): links between distinct fingerprints that connect every two at
    MOST_BITS or fewer, directly or through others."""
    distinct = fingerprints.select(F.col(fp).alias("fp")).distinct()
    postings = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(MASKS) - 1))).alias("c"))
    signed = [m - (1 << 64) if m >> 63 else m for m in MASKS]
    masks = "array(" + ",".join(f"{m}L" for m in signed) + ")"
    key = F.expr(f"fp & element_at({masks}, c + 1)")
    dealt = postings.repartition(F.col("c"), key).sortWithinPartitions(F.col("c"), key, F.col("fp"))
    return dealt.mapInArrow(_spans, "a long, b long").distinct()


def classes(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for each distinct fp of ``prints`` (fp, doc_id)."""
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).checkpoint()
    roots = components(links(firsts))
    members = firsts.join(roots, F.col("fp") == F.col("node"), "left")
    members = members.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = members.groupBy("root").agg(F.min("first").alias("component_id"))
    return members.join(ids, "root").select("fp", "first", "root", "component_id")


def components_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits),
    component_id (the smallest doc_id that can be reached)."""
    prints = docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(text, shingle).alias("fp")).checkpoint()
    found = classes(prints).select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One document of each component: the one with the smallest doc_id (of
    several with that id, the one with the smallest fingerprint)."""
    print_ = fingerprint_column(text, shingle)
    prints = docs.select(F.col(doc_id).alias("doc_id"), print_.alias("fp")).checkpoint()
    first = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("x")
    kept = classes(prints).groupBy("root").agg(first).select(F.col("x.first").alias("__first"), F.col("x.fp").alias("__kept"))
    # the document as one column, so that no name of its columns matters
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), print_.alias("fp"))
    id_, text_ = F.col("doc").getField(doc_id), F.col("doc").getField(text)
    rows = rows.join(kept, (F.col("fp") == F.col("__kept")) & id_.eqNullSafe(F.col("__first")))
    one = Window.partitionBy("fp", id_).orderBy(text_)  # rows that repeat
    return rows.withColumn("row", F.row_number().over(one)).where("row = 1").select("doc.*")
