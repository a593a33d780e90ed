"""Threshold-scaled sketches of documents (FracMinHash): every shingle hash
below a fixed fraction of the hash range is retained.

Shingles are ``SHINGLE`` consecutive words `[^\\x20\\x09-\\x0D]+` (fewer
words: the whole sequence), hashed to 48 bits.  A sketch holds all hashes
below 2**48 / ``SCALE`` and no others, whatever the length of the text.
Sketches of parts merge into the sketch of the whole by union, and they
compare texts of very unequal length: the share of a sketch's hashes that the
other one holds estimates how much of the one text is contained in the other.

A text of s shingles keeps about s / SCALE hashes; its estimate is off by about
sqrt(p (1 - p) SCALE / s) for a true share p.  It has no hash at all with
probability (1 - 1 / SCALE)**s, at SCALE 2 one in two for a text of a single
shingle and one in a thousand for one of ten.

Defined results: null text is empty; a text without words, or without a hash
below the fraction, has an empty sketch, which is contained in an empty one
(1.0) and in no other (0.0); equal texts have equal sketches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.ranges import RANGE_BYTES, ranges_for
from basketry.llm.text import WordCodes, window_hashes, words

SHINGLE = 5
SCALE = 2
_BITS = 48
THRESHOLD = np.uint64((1 << _BITS) // SCALE)


def trim(hashes: np.ndarray) -> np.ndarray:
    """The retained ones of sorted distinct hashes."""
    return hashes[:np.searchsorted(hashes, THRESHOLD)]


def sketch(raw: bytes, codes: WordCodes, shingle: int = SHINGLE) -> np.ndarray:
    tokens = words(raw)
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    return trim(np.unique(window_hashes(codes.of(tokens), min(shingle, len(tokens))) >> np.uint64(64 - _BITS)))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return float(not len(b))
    return float(np.isin(a, b, assume_unique=True).mean())


def encode(s: np.ndarray) -> str:
    """Base64 of the hashes, ascending, six bytes each."""
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(np.uint64)


def sketches(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the sketch of each text as a string."""
    codes: WordCodes | None = None

    def prints(column: pa.Array) -> pa.Array:
        nonlocal codes
        codes = codes if codes is not None else WordCodes()
        return pa.array([encode(sketch((t or "").encode(), codes)) for t in column.to_pylist()], pa.string())
    return docs.withColumn(name, F.arrow_udf(prints, "string")(F.col(text)))


_COLUMNS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document of a sorted stream against its edited text and the next
    document.  Holds one document and one batch."""
    codes = WordCodes()
    held = None  # (doc_id, text, sketch) that waits for its next document

    def row(doc_id, text, own, after, other):
        k = len(text) // 4
        edited = (text[:len(text) - k] + after[:k]).encode()
        changed = sketch(edited, codes)
        return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), encode(own), encode(changed),
                containment(own, changed), containment(own, other))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _COLUMNS)], [n for n, _ in _COLUMNS])

    for part in batches:
        rows = []
        for doc_id, text, peek in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "peek"))):
            if peek and held is None:
                continue
            text = text or ""
            own = sketch(text.encode(), codes)
            if held is not None:
                rows.append(row(*held, text, own))
            held = None if peek else (doc_id, text, own)
        if rows:
            yield batch(rows)
    if held is not None:  # no next document
        yield batch([row(*held, "", sketch(b"", codes))])


def against_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per document: n_chars, the sha256 of its edited text (its last quarter
    of code points replaced by the beginning of the next document in
    ascending doc_id, text order; after the last comes the first), both
    sketches, and how much of its sketch the edited text's and the next
    document's hold.

    The table is cut into ranges of doc_id; the first document of a range is
    also sent to the range before it.  Rows without a doc_id stand outside
    the order: nothing replaces their last quarter and near_next is that to
    an empty text."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranges = ranges_for(docs, "doc_id", "text", range_bytes)
    rows = docs.where("doc_id IS NOT NULL").withColumn("range", ranges.range_of("doc_id"))
    own = F.struct(F.col("range"), F.lit(0).alias("peek"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(ranges.count)).cast("int").alias("range"), F.lit(1).alias("peek"))
    sent = F.when(ranges.starts_range("doc_id"), F.array(own, before)).otherwise(F.array(own))
    rows = rows.select("doc_id", "text", F.inline(sent))
    rows = rows.repartitionById(ranges.count, F.col("range")).sortWithinPartitions("peek", "doc_id", "text")
    found = rows.select("doc_id", "text", "peek").mapInArrow(_compare, _SCHEMA)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for i in range(part.num_rows):
                yield from _compare(iter([part.slice(i, 1)]))

    return found.union(docs.where("doc_id IS NULL").withColumn("peek", F.lit(0)).mapInArrow(alone, _SCHEMA))
