"""Token-ID files as wavelet matrices, and their reader.

Texts are encoded with a public tokenizer (its path is a parameter), an end
id is appended to each, and the ids are written in ascending doc_id order:
files for each range of doc_id, each a sequence of shards of about
``SHARD_TOKENS`` ids.  A shard is self-contained:

    magic "WVLT0001"; u64 bytes in all; u32 range; u32 number in the range;
    u64 ids; u32 documents; u8 bit-planes;
    u32 size, zstd(doc_ids i64, their null flags u8, ids of each u64);
    per plane, from the highest bit: u64 zeros; u32 blocks; u32 bytes of each
    block; u64 ones before each block; the blocks, zstd each of 64 KB of bits;
    the byte 0x0A.

Plane k holds bit k of the ids in the order of plane k: the ids with a 0 in
the plane above come first, then those with a 1, both in the order of the
plane above.  With the counts of ones this supports access to any id,
counting an id before a position and finding its occurrences, each by
opening one block a plane and step (``Shard``).

Defined results: null text is empty (its one id is the end id); null doc_ids
come first and are read back as null; equal doc_ids are ordered by text and
rows that repeat are written each.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.llm.ranges import text_bytes
from basketry.llm.store import read_blobs, write_blobs
from basketry.llm.text import release_memory

END_ID = 2
SHARD_TOKENS = 1 << 20
#: Text bytes of a range on average, and bytes of a file at about the most.
FILE_BYTES = 16 << 20
#: Text bytes encoded at once, and texts or parts given to the library at once.
STEP_BYTES = 4 << 20
BATCH_TEXTS = 2000
MAGIC = b"WVLT0001"
_HEAD = struct.Struct("<8sQIIQIB")
_BLOCK = 1 << 16  # bytes of bits
_RUN = 1 << 16  # ids ordered at once, so that they stay in the processor's cache


# ---- encoding -------------------------------------------------------------

#: White space, in full, as the tokenizer's pattern knows it.
_SPACE = r"\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f"
#: A space may begin a new part unless white space or the end follows: the
#: tokenizer's own cut always lies before such a space.  Other texts, and such
#: as may hold special tokens, go in whole.
_NOT_PLAIN = rf" ([{_SPACE}]|$)|\x01|<\|"
#: Parts without white space but for a space before them: line ends may be put
#: between them without a change of their ids.
_JOINED = rf"^ ?[^{_SPACE}]+$"
#: Such parts given to the library in one string.
_TOGETHER = 500
#: Marks that may follow a word or number; those up to the part's end are one
#: piece by themselves.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that have been letters in every version of Unicode that counts.
_LATIN = r"A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
#: A part that is one word of them, or one number.
_WORD = rf"^ ?([{_LATIN}]+|[0-9]+)$"
#: A line end between two visible characters is a piece by itself.
_LINE_END = rf"([!-~{_LATIN}])\n([!-~{_LATIN}])"


def _byte_level() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the
    other bytes, in order, for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LEVEL = _byte_level()
#: The same, by byte.
_POINTS = np.array([ord(_BYTE_LEVEL[b]) for b in range(256)], dtype="<u2")


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1 ... of all spans, one after another."""
    ends = np.cumsum(lengths, dtype=np.int32)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)


def _before(counts: np.ndarray) -> np.ndarray:
    """Where each of some runs of ids begins.  An Arrow string array holds
    less than 2**31 bytes, and so its texts have fewer ids."""
    return np.cumsum(counts, dtype=np.int32) - counts


def _offsets(strings: pa.Array) -> np.ndarray:
    """Where each string begins in the array's bytes, and their end."""
    return np.frombuffer(strings.buffers()[1] or bytes(4), np.int32, len(strings) + 1, 4 * strings.offset)


def _expanded(coded: pa.DictionaryArray, encode) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all strings, one after another, and the number of each, from
    those of the distinct ones."""
    ids, counts = encode(coded.dictionary)
    at = np.asarray(coded.indices)
    return ids[_spans(_before(counts)[at], counts[at])], counts[at]


def _merged(mine: np.ndarray, own: tuple[np.ndarray, np.ndarray], rest: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of runs of ids as one: ``mine`` tells whose turn it is."""
    counts = np.empty(len(mine), dtype=np.int32)
    counts[mine], counts[~mine] = own[1], rest[1]
    starts, ids = _before(counts), np.empty(int(counts.sum()), dtype=np.uint32)
    ids[_spans(starts[mine], counts[mine])], ids[_spans(starts[~mine], counts[~mine])] = own[0], rest[0]
    return ids, counts


class Encoder:
    """Ids of texts by the tokenizers library.  A byte-level tokenizer with
    its standard pattern cuts before every single space and around single
    line ends, so a text's ids are those of the parts between; each distinct
    part is encoded once.  Words, numbers and the marks after them are pieces
    that are remembered, up to ``limit`` bytes of memory."""

    def __init__(self, path: str, limit: int = 64 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer
        self.by_parts = (isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
                         and self.tokenizer.normalizer is None)
        # any other added token could lie in a word or among marks
        self.by_parts = self.by_parts and all("<|" in t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model = self.tokenizer.model
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_parts = self.by_parts and len(line_end) == 1
        self.line_end = line_end[0] if line_end else None
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.pieces = pa.array([], pa.string())
        self.ids, self.counts = np.empty(0, np.uint32), np.empty(0, np.int32)  # of each piece
        self.hashes, self.numbers = np.empty(0, np.int64), np.empty(0, np.int32)  # ascending, and whose they are

    @property
    def held(self) -> int:
        """Bytes of memory of what is remembered."""
        return sum(x.nbytes for x in (self.pieces, self.ids, self.counts, self.hashes, self.numbers))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, each by itself, and the number of each; a few
        at a time, as the library's results are many times their ids."""
        ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i in range(0, len(texts), BATCH_TEXTS):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i:i + BATCH_TEXTS], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def _together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_whole``, for parts like ``_JOINED``: many in one string, with
        a line end between any two; its id, which no such part holds, tells
        them apart again."""
        groups = [parts[i:i + _TOGETHER] for i in range(0, len(parts), _TOGETHER)]
        ids, counts = self._whole(["\n".join(g) for g in groups])
        cut = np.flatnonzero(ids == self.line_end)
        # every part ends before a line end's id, or where its group ends
        last = np.zeros(len(parts), dtype=bool)
        last[_TOGETHER - 1::_TOGETHER] = True
        last[-1:] = True
        if len(cut) + last.sum() != len(parts):
            return self._whole(parts)
        ends = np.empty(len(parts), dtype=np.int64)
        ends[~last], ends[last] = cut, np.cumsum(counts)
        starts = np.concatenate(([0], np.where(last, ends, ends + 1)))[:-1]
        return np.delete(ids, cut), ends - starts

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of single words: one piece each to the tokenizer's pattern,
        so its merges are asked for directly."""
        ends = _offsets(words).tolist()
        spelled = _POINTS[np.frombuffer(words.buffers()[2] or b"", np.uint8, ends[-1])].tobytes().decode("utf-16-le")
        tokenize, ids, counts = self.model.tokenize, [], []
        for a, b in zip(ends, ends[1:]):
            found = tokenize(spelled[a:b])
            counts.append(len(found))
            ids += [t.id for t in found]
        return np.array(ids, dtype=np.uint32), np.array(counts, dtype=np.int32)

    def _others(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of any parts by the library's whole call, many at once where
        they are like ``_JOINED``."""
        joined = np.asarray(pc.match_substring_regex(parts, _JOINED))
        return _merged(joined, self._together(parts.filter(pa.array(joined)).to_pylist()), self._whole(parts.filter(pa.array(~joined)).to_pylist()))

    @staticmethod
    def _hashes(strings: pa.Array) -> np.ndarray:
        ends = _offsets(strings).tolist()
        raw = memoryview(strings.buffers()[2] or b"")[:ends[-1]].tobytes()
        return np.fromiter((hash(raw[a:b]) for a, b in zip(ends, ends[1:])), np.int64, len(strings))

    def _remembered(self, pieces: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct strings, new ones being encoded.  A string is
        found by its hash and then compared."""
        hashes = self._hashes(pieces)
        order = np.argsort(hashes)  # neighbours are found side by side
        hashes = hashes[order]
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(pieces), dtype=bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        own = self.numbers[at[known]]
        known[known] = np.asarray(pc.equal(self.pieces.take(pa.array(own)), pieces.take(pa.array(order[known]))))
        numbers = np.empty(len(pieces), dtype=np.int32)
        numbers[order[known]] = self.numbers[at[known]]
        new = np.sort(order[~known])
        fresh = pieces.take(pa.array(new))
        numbers[new] = np.arange(len(self.pieces), len(self.pieces) + len(new), dtype=np.int32)
        if len(new):
            ids, counts = encode(fresh)
            self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))
            self.pieces = pa.concat_arrays([self.pieces, fresh])
            self.hashes = np.insert(self.hashes, at[~known], hashes[~known])
            self.numbers = np.insert(self.numbers, at[~known], numbers[order[~known]])
        sizes = self.counts[numbers]
        found = self.ids[_spans(_before(self.counts)[numbers], sizes)]
        if self.held > self.limit:
            self._forget()
        return found, sizes

    def _distinct(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct parts.  A word or number and the marks after it
        are asked for one by one."""
        bodies = pc.ascii_rtrim(parts, characters=_MARKS)
        simple = np.asarray(pc.match_substring_regex(bodies, _WORD))
        mine = parts.filter(pa.array(simple))
        cuts = np.repeat(_offsets(mine), 2)[:-1]
        cuts[1::2] += np.asarray(pc.binary_length(bodies.filter(pa.array(simple))))
        pieces = pa.StringArray.from_buffers(2 * len(mine), pa.py_buffer(cuts), mine.buffers()[2])
        ids, counts = _expanded(pieces.dictionary_encode(), lambda p: self._remembered(p, self._words))
        others = self._remembered(parts.filter(pa.array(~simple)), self._others)
        return _merged(simple, (ids, counts.reshape(-1, 2).sum(axis=1)), others)

    def _by_parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.replace_substring_regex(pc.replace_substring(texts, " ", "\x01 "), _LINE_END, "\\1\x01\n\x01\\2")
        lists = pc.split_pattern(cut, "\x01")
        ids, counts = _expanded(lists.flatten().dictionary_encode(), self._distinct)
        bounds = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        return ids, np.diff(bounds)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), one after another, and the
        number of each."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        plain = np.asarray(pc.invert(pc.match_substring_regex(texts, _NOT_PLAIN))) if self.by_parts else np.zeros(len(texts), bool)
        if plain.all() and len(texts):
            return self._by_parts(texts)
        found: list = [None] * len(texts)
        if plain.any():
            ids, counts = self._by_parts(texts.filter(pa.array(plain)))
            for i, part in zip(np.flatnonzero(plain).tolist(), np.split(ids, np.cumsum(counts)[:-1])):
                found[i] = part
        odd = np.flatnonzero(~plain).tolist()
        for i in odd:
            found[i] = self._whole([texts[i].as_py()])[0]
        return np.concatenate([np.empty(0, np.uint32), *found]), np.array([len(x) for x in found], dtype=np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each tokenizer in a worker process, with what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- the file format ------------------------------------------------------

def shard(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray, bits: int, owner: int, number: int) -> bytes:
    """The bytes of a shard but for the last one, 0x0A."""
    compress = zstandard.ZstdCompressor(level=1).compress
    none = np.array([d is None for d in doc_ids], dtype=np.uint8)
    table = compress(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + none.tobytes() + np.asarray(counts, dtype="<u8").tobytes())
    body = [struct.pack("<I", len(table)), table]
    values = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for bit in reversed(range(bits)):
        ones = (values & values.dtype.type(1 << bit)) != 0
        raw = np.packbits(ones, bitorder="little")
        parts = [raw[i:i + _BLOCK] for i in range(0, len(raw), _BLOCK)]
        blocks = [compress(p.tobytes()) for p in parts]
        counted = np.array([0, *(int(np.bitwise_count(p).sum(dtype=np.int64)) for p in parts)], dtype="<u8").cumsum()[:-1]
        low, high = [], []
        for i in range(0, len(values), _RUN):
            some, one = values[i:i + _RUN], ones[i:i + _RUN]
            low.append(some.compress(~one))
            high.append(some.compress(one))
        body += [struct.pack("<QI", sum(map(len, low)), len(blocks)), np.array([len(b) for b in blocks], dtype="<u4").tobytes(),
                 counted.astype("<u8").tobytes(), *blocks]
        values = np.concatenate([values[:0], *low, *high])
    size = _HEAD.size + sum(map(len, body)) + 1
    return b"".join([_HEAD.pack(MAGIC, size, owner, number, len(ids), len(doc_ids), bits), *body])


class _Plane:
    """A bit-plane: bits by position, ones before a position, the position of
    the k-th one or zero.  Opens only the block it needs."""

    def __init__(self, view: memoryview, at: int, n: int):
        self.n = n
        self.zeros, blocks = struct.unpack_from("<QI", view, at)
        sizes = np.frombuffer(view, "<u4", blocks, at + 12)
        self.before = np.frombuffer(view, "<u8", blocks, at + 12 + 4 * blocks).astype(np.int64)
        self.starts = at + 12 + 12 * blocks + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self.end = int(self.starts[-1])
        self.view = view
        self._open = (-1, np.empty(0, np.uint8))

    def _block(self, i: int) -> np.ndarray:
        if self._open[0] != i:
            raw = zstandard.ZstdDecompressor().decompress(self.view[self.starts[i]:self.starts[i + 1]], max_output_size=_BLOCK)
            self._open = (i, np.frombuffer(raw, np.uint8))
        return self._open[1]

    def bit(self, i: int) -> int:
        block, i = divmod(i, 8 * _BLOCK)
        return int(self._block(block)[i >> 3] >> (i & 7) & 1)

    def ones(self, i: int) -> int:
        """Ones among the first i bits."""
        if not i:
            return 0
        block, rest = divmod(i, 8 * _BLOCK)
        if not rest:
            block, rest = block - 1, 8 * _BLOCK
        raw = self._block(block)
        part = int(np.bitwise_count(raw[:rest >> 3]).sum(dtype=np.int64))
        return int(self.before[block]) + part + (int(raw[rest >> 3] & ((1 << (rest & 7)) - 1)).bit_count() if rest & 7 else 0)

    def find(self, k: int, one: bool) -> int:
        """The position of the k-th (from 0) one, or zero."""
        before = self.before if one else np.arange(len(self.before)) * 8 * _BLOCK - self.before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._block(block), bitorder="little")[:self.n - block * 8 * _BLOCK]
        return block * 8 * _BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def all(self) -> np.ndarray:
        raw = [self._block(i) for i in range(len(self.before))]
        return np.unpackbits(np.concatenate([np.empty(0, np.uint8), *raw]), count=self.n, bitorder="little").view(bool)


class Shard:
    """A shard read from bytes at an offset."""

    def __init__(self, content: bytes | memoryview, at: int = 0):
        view = memoryview(content)
        magic, self.size, self.owner, self.number, self.n, docs, self.bits = _HEAD.unpack_from(view, at)
        if magic != MAGIC or at + self.size > len(view):
            raise ValueError("not a whole shard of token ids")
        size, = struct.unpack_from("<I", view, at + _HEAD.size)
        place = at + _HEAD.size + 4
        table = zstandard.ZstdDecompressor().decompress(view[place:place + size])
        none = np.frombuffer(table, np.uint8, docs, 8 * docs)
        self.doc_ids = [None if m else d for d, m in zip(np.frombuffer(table, "<i8", docs).tolist(), none.tolist())]
        self.counts = np.frombuffer(table, "<u8", docs, 9 * docs).astype(np.int64)
        place += size
        self.planes = []
        for _ in range(self.bits):
            self.planes.append(_Plane(view, place, self.n))
            place = self.planes[-1].end

    def access(self, i: int) -> int:
        """The id at a position."""
        value = 0
        for plane in self.planes:
            bit = plane.bit(i)
            i = plane.zeros + plane.ones(i) if bit else i - plane.ones(i)
            value = value << 1 | bit
        return value

    def count(self, value: int, end: int | None = None) -> int:
        """How often an id occurs before a position (default: at all)."""
        if value >> self.bits:
            return 0
        a, b = 0, self.n if end is None else end
        for plane, bit in zip(self.planes, self._bits(value)):
            a, b = (plane.zeros + plane.ones(a), plane.zeros + plane.ones(b)) if bit else (a - plane.ones(a), b - plane.ones(b))
        return b - a

    def occurrence(self, value: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        a = 0
        for plane, bit in zip(self.planes, self._bits(value)):
            a = plane.zeros + plane.ones(a) if bit else a - plane.ones(a)
        a += k
        for plane, bit in zip(reversed(self.planes), reversed(self._bits(value))):
            a = plane.find(a - plane.zeros, True) if bit else plane.find(a, False)
        return a

    def _bits(self, value: int) -> list[int]:
        return [value >> b & 1 for b in reversed(range(self.bits))]

    def all(self) -> np.ndarray:
        """Every id, in order: the planes from the last to the first."""
        values = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for k, plane in enumerate(reversed(self.planes)):
            ones = plane.all()
            values[plane.zeros:] |= values.dtype.type(1 << k)
            above, zero, one = np.empty_like(values), 0, plane.zeros
            for i in range(0, self.n, _RUN):
                some, bits = above[i:i + _RUN], ones[i:i + _RUN]
                low, high = np.flatnonzero(~bits), np.flatnonzero(bits)
                some[low], some[high] = values[zero:zero + len(low)], values[one:one + len(high)]
                zero, one = zero + len(low), one + len(high)
            values = above
        return values


def shards(content: bytes) -> Iterator[Shard]:
    """The shards of a file."""
    at = 0
    while at < len(content):
        found = Shard(content, at)
        yield found
        at += found.size


# ---- the Spark jobs -------------------------------------------------------

def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about STEP_BYTES of text (one document at least)."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + STEP_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                 end_id: int = END_ID, file_bytes: int = FILE_BYTES, shard_tokens: int = SHARD_TOKENS) -> None:
    """Token files of ``docs`` in ``folder``.  Spark's range partitioner deals
    the documents out by doc_id; each range is written as one file, or as
    several where its texts are long, with their shards in order."""
    from tokenizers import Tokenizer

    bits = max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id, 1).bit_length()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = max(1, math.ceil(text_bytes(rows) / file_bytes))
    # the beginning of the text parts equal and null ids, too, in the order of the sort
    rows = rows.repartitionByRange(n, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    rows = rows.withColumn("range", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        ids, counts, doc_ids, number, owner = np.empty(0, np.uint32), np.empty(0, np.int64), [], 0, 0

        def blob(docs: int):
            """A shard of the first documents that wait."""
            nonlocal ids, counts, doc_ids, number
            n = int(counts[:docs].sum())
            raw = shard(ids[:n], doc_ids[:docs], counts[:docs], bits, owner, number)
            ids, counts, doc_ids, number = ids[n:], counts[docs:], doc_ids[docs:], number + 1
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["blob"])

        for step in _steps(batches):
            owner = step.column("range")[0].as_py()
            found, n = encode(step.column("text"))
            ids = np.concatenate((ids, np.insert(found, np.cumsum(n), end_id)))
            counts = np.concatenate((counts, n + 1))
            doc_ids += step.column("doc_id").to_pylist()
            while len(ids) >= shard_tokens:
                yield blob(int(np.searchsorted(np.cumsum(counts), shard_tokens)) + 1)
            release_memory()
        if doc_ids:
            yield blob(len(doc_ids))
        release_memory()

    # a shard has shard_tokens ids and a document's at most; a range with more
    # bytes than others goes on in further files
    write_blobs(rows.mapInArrow(write, "blob binary"), "blob", folder, max(1, file_bytes // (2 * shard_tokens)))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document, from the files: range, shard, place (ids of the
    shard before it), doc_id, n_tokens, ids_crc32."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "shard", "place", "doc_id", "n_tokens", "ids_crc32"]
        for batch in batches:
            for content in batch.column("content"):
                for s in shards(content.as_py()):
                    raw = memoryview(s.all().astype("<u4")).cast("B")
                    ends = np.cumsum(s.counts)
                    crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), s.counts.tolist())]
                    k = len(crc)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([s.owner] * k, pa.int32()), pa.array([s.number] * k, pa.int32()), pa.array(ends - s.counts, pa.int64()),
                        pa.array(s.doc_ids, pa.int64()), pa.array(s.counts, pa.int64()), pa.array(crc, pa.int64())], names)
                    release_memory()

    return read_blobs(spark, folder).mapInArrow(read, "range int, shard int, place long, doc_id long, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame) -> DataFrame:
    """Rows of ``read_tokens`` with start: ids of all documents before it.
    Sums of shards, then of ranges: one row for each of them."""
    rows = rows.checkpoint()
    sizes = rows.groupBy("range", "shard").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_range = sizes.select("range", "shard", before(Window.partitionBy("range").orderBy("shard")).alias("b"))
    ranges = sizes.groupBy("range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("range", before(Window.partitionBy().orderBy("range")).alias("a"))
    places = in_range.join(ranges, "range").select("range", "shard", (F.col("a") + F.col("b")).alias("before"))
    return rows.join(places, ["range", "shard"]).withColumn("start", F.col("before") + F.col("place")).drop("before")
