"""Substring removal: word windows of fixed length that also start in an
earlier document are removed, wherever they lie.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  Every window of ``WIDTH`` words
gets a 64-bit Rabin-Karp hash.  A window is removed if its hash also occurs
in a document with a smaller doc_id; overlapping and touching windows of a
document merge into maximal intervals of words.  Windows are judged on the
input, not on what is left.

Documents are cut into ranges of doc_id, in ascending order, so "an earlier
range has the hash" needs no ids.  The cuts follow the bytes of the rows.  A
doc_id whose rows exceed a range is a range by itself, dealt into pieces row
by row: its rows don't remove each other's windows, so they need not meet.
Every other range is one piece.  Three steps, all keyed:

1. piece: the distinct hashes of a piece, sorted, are cut by value into
   buckets and sent as packed differences (about six bytes a window).
2. bucket: the hashes of all pieces meet; one bit says for each whether an
   earlier range has it.  A passage in a third of all documents is one entry
   a piece here, however often it repeats.
3. piece: the bits come back to the piece's documents (dealt as in step 1,
   so Spark shuffles the texts once), which are judged and cut.

Two different windows share a hash with probability 2**-64: over n windows
about n*n / 2**65 pairs may be wrong (1e-4 at 1e8 windows).

Ranges and buckets grow in number with the text.  On inputs of many TB raise
``range_bytes`` towards 256 MB, so that a piece keeps some dozens of hashes
for each bucket.

Defined results: null text has no words; rows that repeat a doc_id don't
remove each other's windows; rows without a doc_id keep all words and
remove none elsewhere; a text of fewer than ``WIDTH`` words stays whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.ranges import RANGE_BYTES, Ranges, byte_cuts, text_bytes
from basketry.llm.text import WordCodes, as_bytes, covered, window_hashes, words

WIDTH = 13
#: Text bytes for one bucket of hashes (about six bytes of text a window).
BUCKET_BYTES = 8 << 20


def pack(values: np.ndarray) -> bytes:
    """Ascending uint64: the width of a difference, the first value, the
    differences in as many bytes."""
    if not len(values):
        return b""
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + values[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, dtype=np.uint64)
    width = raw[0]
    steps = np.frombuffer(raw, dtype=np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(steps) + 1, 8), dtype=np.uint8)
    out[1:, :width] = steps
    out = out.reshape(-1).view(np.uint64)
    out[:1] = np.frombuffer(raw, dtype=np.uint64, offset=1, count=1)
    return np.cumsum(out, dtype=np.uint64)


def _bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of sorted hashes begins, and the end."""
    edges = np.array([(i << 64) // buckets for i in range(buckets)], dtype=np.uint64)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def _hashed(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The window hashes of all texts, one after another; how many of each."""
    codes = WordCodes()
    found = [window_hashes(codes.of(words(raw)), width) if raw else np.empty(0, np.uint64) for raw in texts]
    return np.concatenate([np.empty(0, np.uint64), *found]), np.array([len(x) for x in found], dtype=np.int64)


def _sender(width: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        hashes, _ = _hashed(as_bytes(table.column("__text")), width)
        hashes = np.unique(hashes)
        at = _bounds(hashes, buckets).tolist()
        filled = [i for i in range(buckets) if at[i] < at[i + 1]]
        owner, piece = (table.column(c)[0].as_py() for c in ("__range", "__piece"))
        return pa.table({
            "range": pa.array([owner] * len(filled), pa.int32()),
            "piece": pa.array([piece] * len(filled), pa.int32()),
            "bucket": pa.array(filled, pa.int32()),
            "hashes": pa.array([pack(hashes[at[i]:at[i + 1]]) for i in filled], pa.binary()),
        })
    return send


def _seen_before(table: pa.Table) -> pa.Table:
    """For each piece of a bucket: bits for the hashes that a piece of an
    earlier range has.  Pieces without any are left out."""
    table = table.sort_by("range")
    found = [unpack(raw) for raw in table.column("hashes").to_pylist()]
    lengths = [len(p) for p in found]
    hashes = np.concatenate(found)
    del found
    owners = np.repeat(np.asarray(table.column("range")), lengths)
    order = np.argsort(hashes, kind="stable")
    hashes, owners = hashes[order], owners[order]
    new = np.append(True, hashes[1:] != hashes[:-1])
    again = np.zeros(len(hashes), dtype=bool)
    again[order] = owners > owners[np.maximum.accumulate(np.where(new, np.arange(len(hashes)), 0))]
    out, at = [], 0
    for *key, n in zip(*(table.column(c).to_pylist() for c in ("range", "piece", "bucket")), lengths):
        if again[at:at + n].any():
            out.append((*key, np.packbits(again[at:at + n]).tobytes()))
        at += n
    kinds = [("range", pa.int32()), ("piece", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())]
    return pa.table({name: pa.array([x[i] for x in out], kind) for i, (name, kind) in enumerate(kinds)})


_ADDED = [("n_words", pa.int64()), ("n_removed", pa.int64()),
          ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]


def _cut(raw: bytes | None, starts: np.ndarray, width: int):
    """Kept words joined by a space, numbers of words and of removed ones,
    and the intervals removed."""
    tokens = words(raw) if raw else []
    gone = covered(starts, width, len(tokens))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
    kept, at, spans = [], 0, []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        kept += tokens[at:a]
        at = b
        spans.append({"start": a, "end": b})
    kept += tokens[at:]
    return b" ".join(kept).decode(), len(tokens), len(tokens) - len(kept), spans


def _judge(width: int, buckets: int, columns: list[str], text: str):
    def judge(docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs = docs.sort_by("__id")
        ids = np.asarray(docs.column("__id"))
        texts = as_bytes(docs.column("__text"))
        hashes, counts = _hashed(texts, width)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        del hashes
        before = np.zeros(len(distinct), dtype=bool)
        at = _bounds(distinct, buckets)
        for bucket, bits in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()):
            a, b = at[bucket], at[bucket + 1]
            before[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).view(bool)
        owner = np.repeat(ids, counts)
        gone = before[which] | (owner[first][which] < owner)
        ends = np.cumsum(counts)
        return _output(docs, [_cut(raw, np.flatnonzero(gone[e - n:e]), width) for raw, e, n in zip(texts, ends, counts)], columns, text)
    return judge


def _output(docs, cut: list[tuple], columns: list[str], text: str) -> pa.Table:
    own = {c: docs.column(f"c_{c}") for c in columns if c != text}
    own[text] = pa.array([x[0] for x in cut], pa.string())
    for i, (name, kind) in enumerate(_ADDED, 1):
        own[name] = pa.array([x[i] for x in cut], kind)
    return pa.table({c: own[c] for c in [*columns, *(n for n, _ in _ADDED)]})


def _dealt(rows: DataFrame, range_bytes: int) -> DataFrame:
    """The rows that have an id, with __range and __piece."""
    cuts, heavy = byte_cuts(rows, "__id", "__text", range_bytes)
    dealt = rows.where("__id IS NOT NULL").withColumn("__range", Ranges(cuts).range_of("__id"))
    if not heavy:
        return dealt.withColumn("__piece", F.lit(0))
    is_heavy = F.col("__id").isin(list(heavy))
    pieces = F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair])[F.col("__id")]
    # dealt in rotation, as equal rows have nothing to tell them apart; the
    # checkpoint keeps each row in its piece
    spread = dealt.where(is_heavy).withColumn("__piece", F.pmod(F.monotonically_increasing_id(), pieces).cast("int")).checkpoint()
    return dealt.where(~is_heavy).withColumn("__piece", F.lit(0)).union(spread)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                   range_bytes: int = RANGE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with the kept words as text (joined by one space), n_words,
    n_removed and spans (word intervals removed, end exclusive).  Input
    columns of these three names are replaced."""
    columns = [c for c in docs.columns if c not in {n for n, _ in _ADDED}]
    schema = T.StructType([docs.schema[c] if c != text else T.StructField(c, T.StringType()) for c in columns] + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    buckets = max(1, math.ceil(text_bytes(docs, text) / bucket_bytes))
    rows = docs.select(*[F.col(c).alias(f"c_{c}") for c in columns if c != text], F.col(doc_id).cast("long").alias("__id"),
                       F.col(text).alias("__text"))
    dealt = _dealt(rows, range_bytes)
    pieces = dealt.groupBy("__range", "__piece").applyInArrow(_sender(width, buckets), "range int, piece int, bucket int, hashes binary")
    replies = pieces.groupBy("bucket").applyInArrow(_seen_before, "range int, piece int, bucket int, bits binary")
    judged = dealt.groupBy("__range", "__piece").cogroup(replies.groupBy("range", "piece")).applyInArrow(
        _judge(width, buckets, columns, text), schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.int64)
        for part in batches:
            yield from _output(part, [_cut(raw, none, width) for raw in as_bytes(part.column("__text"))], columns, text).to_batches()

    return judged.union(rows.where("__id IS NULL").mapInArrow(whole, schema))
