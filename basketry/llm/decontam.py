"""Benchmark decontamination: a broadcast set of the n-grams of normalised
test items; each document's word windows are looked up in it, hits are
verified word by word, and spans or whole documents are removed.

Normal form: A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.
An item's windows are its runs of ``width`` words; an item with fewer words
is one window, an item with none has no window.

Items are broadcast in blocks of at most ``BLOCK_WORDS`` words, so the size
of a broadcast is bounded; a larger benchmark makes more passes over the
documents, each adding its hits to those found before.

Defined results: null text has no words and no hits; an item with a null id
marks words but is not named among the items; items with equal texts are all
named; repeated rows of either table are judged like any other row.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.text import LOWER_ALNUM, WordCodes, as_bytes, covered, release_memory, window_hashes, words

#: Words in an item window.
WIDTH = 10
#: Words of items in one broadcast (about 150 bytes each with the windows).
BLOCK_WORDS = 500_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.LongType())),
])


class Ngrams:
    """The windows of a block of items, by length: sorted hashes for the
    scan, the words of each window for the check, and its items."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int = WIDTH):
        codes = WordCodes()
        found: dict[int, dict[int, dict[tuple, set]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for item_id, text in items:
            tokens = words((text or "").encode().translate(LOWER_ALNUM))
            n = min(width, len(tokens))
            if n:
                for i, h in enumerate(window_hashes(codes.of(tokens), n).tolist()):
                    found[n][h][tuple(tokens[i:i + n])].add(item_id)
        self.by_length = {
            n: (np.sort(np.fromiter(hashes, dtype=np.uint64, count=len(hashes))), {h: {w: sorted(i for i in ids if i is not None) for w, ids in by.items()} for h, by in hashes.items()})
            for n, hashes in found.items()
        }
        # 2**16 flags on the low bits of the hashes spare most of the searches
        self.flags = {}
        for n, (hashes, _) in self.by_length.items():
            flags = np.zeros(1 << 16, dtype=bool)
            flags[(hashes & np.uint64(0xFFFF)).astype(np.intp)] = True
            self.flags[n] = flags

    def hits(self, tokens: list[bytes], codes: WordCodes) -> tuple[np.ndarray, list[int]]:
        """Which words lie in an occurrence of a window, and whose windows occur."""
        hit = np.zeros(len(tokens), dtype=bool)
        items: set[int] = set()
        coded = codes.of(tokens)
        for n, (hashes, by) in self.by_length.items():
            h = window_hashes(coded, n)
            maybe = np.flatnonzero(self.flags[n][(h & np.uint64(0xFFFF)).astype(np.intp)])
            if len(maybe):
                at = np.searchsorted(hashes, h[maybe])
                maybe = maybe[hashes[np.minimum(at, len(hashes) - 1)] == h[maybe]]
            starts = []
            for i in maybe.tolist():
                ids = by[int(h[i])].get(tuple(tokens[i:i + n]))
                if ids is not None:
                    starts.append(i)
                    items.update(ids)
            if starts:
                hit |= covered(np.array(starts), n, len(tokens))
        return hit, sorted(items)


def _scanner(block):
    codes: WordCodes | None = None

    @F.arrow_udf(_HITS)
    def scan(text: pa.Array) -> pa.Array:
        nonlocal codes
        codes = codes if codes is not None else WordCodes()
        grams, out = block.value, []
        for raw in as_bytes(text):
            tokens = words(raw.translate(LOWER_ALNUM)) if raw else []
            hit, items = grams.hits(tokens, codes)
            if hit.any():
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                out.append((len(tokens), edges[::2].tolist(), edges[1::2].tolist(), items))
            else:
                out.append((len(tokens), [], [], items))
        release_memory()
        return pa.array(
            [dict(zip(("n_words", "starts", "ends", "items"), x)) for x in out],
            pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))]),
        )
    return scan


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> list[DataFrame]:
    """The items in parts of at most about ``most`` words (one item at least)."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // (2 * most)) or 1  # a word and its gap are two bytes at least
    if parts == 1:
        return [items]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [items.where(part == i) for i in range(parts)]


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
              item_text: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS, name: str = "hits") -> DataFrame:
    """``docs`` with a column ``name``: n_words; starts and ends (word
    positions of the maximal hit spans of each block of items, end
    exclusive); items.  An input column of that name is replaced."""
    spark = docs.sparkSession
    out = None
    for block in _blocks(benchmark, item_id, item_text, block_words):
        grams = spark.sparkContext.broadcast(Ngrams([tuple(r) for r in block.collect()], width))
        scan = _scanner(grams)(F.col(text))
        if out is None:
            out = docs.withColumn(name, scan)
        else:
            both = {x: F.concat(f"{name}.{x}", f"__more.{x}") for x in ("starts", "ends")}
            both["items"] = F.array_distinct(F.concat(f"{name}.items", "__more.items"))
            out = out.withColumn("__more", scan).withColumn(
                name, F.struct(F.col(f"{name}.n_words").alias("n_words"), *[c.alias(k) for k, c in both.items()])).drop("__more")
    return out


def n_hit(hits: str = "hits") -> str:
    """SQL for the number of hit words: spans of several blocks may overlap,
    so positions are merged in order of their starts."""
    spans = f"array_sort(arrays_zip({hits}.starts, {hits}.ends))"
    return (f"aggregate({spans}, named_struct('n', 0L, 'e', 0), "
            "(s, x) -> named_struct('n', s.n + greatest(0, x.ends - greatest(x.starts, s.e)), 'e', greatest(s.e, x.ends)), s -> s.n)")


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with the columns of ``docs``."""
    found = find_hits(docs, benchmark, name="__hits", **options)
    return found.where(F.size("__hits.starts") == 0).select(*docs.columns)


def _cut(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    for raw, a, b in zip(as_bytes(text), starts.to_pylist(), ends.to_pylist()):
        if a:
            at = [m.span() for m in _WORD.finditer(raw.translate(LOWER_ALNUM))]
            kept, done = [], 0
            for i, j in sorted(zip(a, b)):
                kept.append(raw[done:max(done, at[i][0])])
                done = max(done, at[j - 1][1])
            raw = b"".join([*kept, raw[done:]])
        out.append(None if raw is None else raw.decode())
    return pa.array(out, pa.string())


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents; the text from the first to the last word of each hit
    span is cut out."""
    found = find_hits(docs, benchmark, text=text, name="__hits", **options)
    cut = F.arrow_udf(_cut, "string")(F.col(text), F.col("__hits.starts"), F.col("__hits.ends"))
    return found.withColumn(text, cut).select(*docs.columns)
