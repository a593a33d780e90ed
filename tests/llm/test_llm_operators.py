"""The operators' own interfaces: files, spans, links, indexes, models."""

import hashlib
import random
import struct
from collections import Counter
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from basketry.llm import components, decontam, langid, mixing, quality, ranges, simhash, sketch, substring, text, tokens, url_filter, warc
from basketry.llm.queries import tokenizer_path
from basketry.llm.store import read_blobs, shared_folder, write_blobs
from basketry.session import checkpoint_dir


# ---- helpers

def test_window_hashes_are_the_polynomial():
    codes = np.random.default_rng(1).integers(0, 1 << 64, 40, dtype=np.uint64)
    for width in (1, 2, 13, 40):
        want = [sum(int(c) * pow(text.BASE, width - 1 - j, 1 << 64) for j, c in enumerate(codes[i:i + width])) & text.MASK64 for i in range(41 - width)]
        assert text.window_hashes(codes, width).tolist() == text.mix(np.array(want, np.uint64)).tolist()
    assert len(text.window_hashes(codes, 41)) == 0


def test_covered_merges():
    assert np.flatnonzero(text.covered(np.array([0, 1, 5, 8]), 3, 10)).tolist() == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    assert not text.covered(np.array([], int), 3, 4).any()


def test_ranges_cut_at_keys(spark):
    df = spark.createDataFrame([(k,) for k in [None, -9, -9, 0, 3, 3, 3, 8, 1 << 62, -(1 << 63)]], "k long")
    r = ranges.Ranges(ranges.cut_points(df, "k", 4))
    found = df.where("k is not null").select("k", r.range_of("k").alias("r"), r.starts_range("k").alias("s")).collect()
    for x in found:
        assert x.r == sum(c <= x.k for c in r.cuts) - 1 and x.s == (x.k in r.cuts)
    assert r.cuts[0] == -(1 << 63)
    assert ranges.Ranges(ranges.cut_points(df.where("k is null"), "k", 4)).count == 1


def test_blobs_round_trip(spark):
    blobs = [bytes(range(256)), b"", b"\xff\xfe\n\x00"]
    folder = shared_folder(spark, "blobs")
    write_blobs(spark.createDataFrame([(b,) for b in blobs], "b binary").repartition(1), "b", folder)
    content = b"".join(bytes(r.content) for r in read_blobs(spark, folder).collect())
    assert sorted(content[:-1].split(b"\n")) == sorted(b"\n".join(blobs).split(b"\n"))
    assert folder.startswith(checkpoint_dir(spark))


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(60)],  # a chain
    [(0, i) for i in range(1, 60)] + [(99, i) for i in range(30, 90)],  # two hubs
    [(random.Random(5).randrange(80), random.Random(i).randrange(80)) for i in range(70)],
    [(1, 1), (None, 2), (3, None)],
    [],
])
def test_components(spark, links):
    want = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            joined = want.get(a, {a}) | want.get(b, {b})
            for x in joined:
                want[x] = joined
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: min(c) for x, c in want.items() if x != min(c)}


# ---- SimHash

def test_postings_meet_exactly_at_five_shared_bytes():
    rng = random.Random(3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(rng.randrange(1, 256) << 8 * p for p in rng.sample(range(8), rng.randrange(6)))
        shared = sum((a >> 8 * p & 255) == (b >> 8 * p & 255) for p in range(8))
        assert any(a & m == b & m for m in simhash.MASKS) == (shared >= simhash.SHARED)


@pytest.mark.parametrize("n, free", [(300, 10), (3000, 13), (1500, 24)])
def test_labels_of_a_posting(n, free):
    mask = simhash.MASKS[17]
    positions = [b for b in range(64) if not mask >> b & 1][:free]
    rng = np.random.default_rng(n)
    values = np.unique(np.array([sum(1 << positions[i] for i in range(free) if x >> i & 1) for x in rng.integers(0, 1 << free, n).tolist()], dtype=np.uint64))
    label = simhash._labels(values, mask)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    want = np.arange(len(values))
    while True:
        less = np.where(near, want[None, :], len(values)).min(axis=1)
        if (less == want).all():
            break
        want = less
    assert (label == want).all()


def test_postings_cut_by_batches():
    """A posting that goes over several batches gives the same components."""
    values = np.unique(np.random.default_rng(2).integers(0, 1 << 10, 300).astype(np.uint64))
    c = np.full(len(values), len(simhash.MASKS) - 1, dtype=np.int32)  # the free bytes are the lowest

    def run(step):
        batches = (pa.RecordBatch.from_arrays([pa.array(c[i:i + step]), pa.array(values[i:i + step].view(np.int64))], ["c", "fp"]) for i in range(0, len(values), step))
        return sorted((a, b) for part in simhash._spans(batches) for a, b in zip(*(x.to_pylist() for x in part.columns)))
    assert run(7) == run(1000)
    assert len(run(7)) < len(values)


def test_keep_first_keeps_one_row(spark):
    many = " ".join(f"word{i}" for i in range(400))
    docs = spark.createDataFrame([(5, many), (3, many.replace("word7 ", "WORD7\t")), (3, many.replace("word7 ", "WORD7\t")), (9, "quite another text"),
                                  (None, "quite another text"), (None, "no id"), (None, "no id"), (4, None), (6, "")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, (r.text or "")[:9]) for r in simhash.keep_first(docs).collect())
    assert got == [(-1, "no id"), (3, "word0 wor"), (4, ""), (9, "quite ano")]


# ---- substrings

def test_pack_round_trip():
    for values in ([], [7], [0, 1 << 63, (1 << 64) - 1], sorted(random.Random(1).getrandbits(64) for _ in range(1000))):
        assert substring.unpack(substring.pack(np.array(values, dtype=np.uint64))).tolist() == values


def test_repeats_with_many_ranges_and_buckets(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    one = substring.remove_repeats(docs)
    many = substring.remove_repeats(docs, range_bytes=20_000, bucket_bytes=9_000)
    assert one.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed", "spans"]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(one) == key(many)
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in one.collect()}
    assert spans[14] == [(0, 60_000)] and spans[13] == []


@pytest.mark.parametrize("shape", ["long texts side by side", "one id, texts differ", "one id, rows alike"])
def test_repeats_hold_bounded_groups(spark, monkeypatch, shape):
    """No group that a worker holds is much larger than a range."""
    rng, most = random.Random(6), 20_000
    said = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage = said(20)
    rows = [(i, f"{said(10)} {passage}") for i in range(400)]
    if shape == "long texts side by side":
        rows += [(1000 + i, f"{said(1500)} {passage}") for i in range(20)]
    else:
        rows += [(200, f"{said(30) if shape == 'one id, texts differ' else 'alike'} {passage}") for _ in range(1500)]
    original = substring._sender

    def sender(*options):
        send = original(*options)

        def checked(table):
            held = sum(len(t) for t in table.column("__text").to_pylist())
            assert held <= 2 * most, held
            return send(table)
        return checked
    monkeypatch.setattr(substring, "_sender", sender)
    found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), range_bytes=most, bucket_bytes=9_000)
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in found.collect()]
    assert sorted(got) == sorted(brute.repeats(rows))


# ---- token files

@pytest.mark.parametrize("bits, n", [(16, 0), (16, 1), (3, 1000), (16, 700_000), (17, 5000)])
def test_wavelet_matrix(bits, n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % (1 << bits)).astype(np.uint32)
    raw = tokens.shard(ids, [4, None], np.array([n, 0]), bits, 7, 2) + b"\n"
    s = tokens.Shard(b"xx" + raw, 2)
    assert (s.size, s.owner, s.number, s.doc_ids, s.counts.tolist()) == (len(raw), 7, 2, [4, None], [n, 0])
    assert (s.all() == ids).all()
    for i in rng.integers(0, n, 20).tolist() if n else []:
        value = int(ids[i])
        places = np.flatnonzero(ids == value)
        assert s.access(i) == value
        assert s.count(value) == len(places) and s.count(value, i) == (places < i).sum()
        k = int(rng.integers(len(places)))
        assert s.occurrence(value, k) == places[k]
    assert s.count(1 << bits) == 0
    with pytest.raises(ValueError):
        tokens.Shard(raw[:-1])


def test_encoder_equals_whole_texts():
    from tokenizers import Tokenizer

    rng = random.Random(4)
    alphabet = ["a", "B", "é", " ", " ", " ", "\n", "\t", " ", " ", "1", "!", "'s", "\x01", "\x1c", "<|endoftext|>", "字", " the"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(3000)] + [None, "", " ", "a  b", "a   b ", " \n x"]
    letters = ["a", "q", "É", "ß", "×", "÷", "ƀ", "ɏ", "ɐ", "ª", "µ", " ", " ", "\n", ".", ",", "'t", "9", "\xa0", "\x85", "\u2028", "-"]
    texts += ["".join(rng.choices(letters, k=rng.randrange(25))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcé1", k=n)) for n in (900, 901, 5000)] + ["x\ny\nz\n\nw.\nV", "a.\n'b", "w, w. w! w? w; w: w.. w,."] * 2
    plain = Tokenizer.from_file(tokenizer_path())
    for limit in (10**6, 50):
        ids, counts = tokens.Encoder(tokenizer_path(), limit).encode(pa.array(texts))
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == list(map(len, want))
        assert ids.tolist() == [i for x in want for i in x]


def test_encoder_asks_once_for_a_word_whatever_follows(monkeypatch):
    from tokenizers import Tokenizer

    asked, merges = Counter(), tokens.Encoder._words

    def counted(self, words):
        asked.update(words.to_pylist())
        return merges(self, words)
    monkeypatch.setattr(tokens.Encoder, "_words", counted)
    monkeypatch.setattr(tokens.Encoder, "_whole", lambda self, texts: pytest.fail(f"whole: {texts}") if texts else (np.empty(0, np.uint32), np.empty(0, np.int64)))
    encoder, plain = tokens.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for mark in ["", ".", ",", "!!", '."', ")", "'", "...", "^_`", "\\]", "-", "***", "", "'"]:
        text = f"some words{mark} 12{mark} étés{mark} Other{mark}"
        assert encoder.encode(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert {"some", " words", " 12", " étés", " Other"} <= set(asked) and max(asked.values()) == 1


def test_encoder_memory_is_bounded():
    encoder = tokens.Encoder(tokenizer_path(), 30_000)
    sizes = []
    for i in range(40):
        words = pa.array([" ".join(f"{chr(97 + i // 2 % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150))])
        assert encoder.encode(words)[0].tolist() == tokens.Encoder(tokenizer_path()).encode(words)[0].tolist()
        sizes.append(encoder.held)
    assert max(sizes) <= 30_000 and any(b < a for a, b in zip(sizes, sizes[1:]))


def test_encoder_compares_pieces_of_one_hash(monkeypatch):
    from tokenizers import Tokenizer

    hashes = tokens.Encoder._hashes
    monkeypatch.setattr(tokens.Encoder, "_hashes", staticmethod(lambda strings: hashes(strings) % 3))
    encoder, plain = tokens.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in ["a b c d e f", "f e d c b a g", "g1 a. b! x-y", "x-y g1 h\ni a", "", "a b c d e f"]:
        assert encoder.encode(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_encoder_finds_added_tokens(tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.add_tokens(["***", "word"])
    plain.save(path := str(tmp_path / "added.json"))
    for text in ["a word*** a*** 12***", "sword wordy. x"]:
        want = plain.encode(text, add_special_tokens=False).ids
        assert tokens.Encoder(path).encode(pa.array([text]))[0].tolist() == want
        assert want != tokens.Encoder(tokenizer_path()).encode(pa.array([text]))[0].tolist()


def test_token_files_with_many_ranges_and_shards(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    found = []
    for options in ({}, {"file_bytes": 50_000, "shard_tokens": 10}):
        folder = shared_folder(spark, "tokens")
        tokens.write_tokens(docs, folder, tokenizer_path(), **options)
        found.append(sorted(map(str, tokens.with_starts(tokens.read_tokens(spark, folder)).drop("range", "shard", "place").collect())))
    assert found[0] == found[1]


@pytest.mark.parametrize("shape", ["null ids", "one id", "long texts side by side"])
def test_token_files_are_bounded(spark, shape):
    """Whatever the ids and lengths, in files of bounded size and in order."""
    rng = random.Random(7)
    said = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = [(i, said(30)) for i in range(1200)]
    if shape == "long texts side by side":
        rows = [(i, said(1000) if 600 <= i < 640 else t) for i, t in rows]
    else:
        rows = [((None if shape == "null ids" else 77) if i % 3 == 0 else i, t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder, file_bytes = shared_folder(spark, "tokens"), 40_000
    tokens.write_tokens(docs, folder, tokenizer_path(), file_bytes=file_bytes, shard_tokens=5_000)
    sizes = [len(r.content) for r in read_blobs(spark, folder).collect()]
    assert len(sizes) > 3 and max(sizes) < 2 * file_bytes
    got = tokens.with_starts(tokens.read_tokens(spark, folder)).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.doc_id for r in got] == [d for d, _ in order]
    encoded = tokens.Encoder(tokenizer_path()).encode(pa.array([t for _, t in order]))[1] + 1
    assert [r.n_tokens for r in got] == encoded.tolist() and [r.start for r in got] == (np.cumsum(encoded) - encoded).tolist()


# ---- decontamination

def test_blocks_of_a_benchmark(spark, edge):
    docs, items = (spark.read.parquet(f"{edge}/{t}.parquet") for t in ("documents", "benchmark"))
    one = decontam.find_hits(docs, items)
    many = decontam.find_hits(docs, items, block_words=20)
    view = lambda df: sorted(map(str, df.select("doc_id", F.expr(decontam.n_hit()), F.array_sort("hits.items")).collect()))
    assert view(one) == view(many)


def test_removal(spark, edge):
    docs, items = (spark.read.parquet(f"{edge}/{t}.parquet") for t in ("documents", "benchmark"))
    kept = decontam.remove_documents(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, 7, 8, 9, 10, 11, 12, 15}
    cut = {r.doc_id: r.text for r in decontam.remove_spans(docs, items).collect() if r.doc_id in (1, 2, 7)}
    assert cut == {1: " one", 2: "Intro. ! two", 7: None}
    assert decontam.remove_documents(docs, items.limit(0)).count() == docs.count()


# ---- WARC

def test_archive_round_trip(spark, edge):
    pages = spark.read.parquet(f"{edge}/pages.parquet")
    folder = shared_folder(spark, "warc")
    warc.write_archives(pages, folder)
    got = warc.read_archives(spark, folder).collect()
    first = {r.page_id: r.html or "" for r in pages.collect()}
    for r in got:
        if r.record_type == "response" and r.page_id is not None:
            assert bytes(r.payload).decode() == first[r.page_id]
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(1, 0), (2, 0), (None, 0), (12, 11)}
    assert next(r.url for r in got if r.page_id == 8) == "ftp://c.com/fr/%0D%0AX:%20y"


def test_archive_format():
    records = [warc.record(i, f"http://x/{i}", b"<p>some html text</p>" * 20, 400, "00", None) for i in range(2000)]
    content = b"".join(part + b"\n" for part in warc.archive(iter(records)))
    magic, size = struct.unpack_from("<II", content)
    assert magic == warc.DICTIONARY_MAGIC and 0 < size <= warc.DICTIONARY_BYTES
    assert list(warc.read_archive(content)) == records
    # any frame can be opened alone with the dictionary
    dictionary = zstandard.ZstdCompressionDict(content[8:8 + size])
    opened = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(content[8 + size:8 + size + 5000])
    assert opened == records[0]
    assert list(warc.archive(iter([]))) == []
    assert list(warc.read_archive(b"".join(p + b"\n" for p in warc.archive(iter([b"tiny"]))))) == [b"tiny"]
    with pytest.raises(ValueError):
        list(warc.read_archive(content[:-20]))


def test_archive_files_are_bounded(spark, tmp_path):
    """One partition, incompressible pages: files end near the bytes asked
    for, each opens alone, and nothing is lost between them."""
    pages = spark.range(300, numPartitions=1).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "sha2(cast(id AS string), 512) || sha2(cast(-id - 1 AS string), 512) AS html")
    pages = pages.unionByName(pages.where("page_id < 20").selectExpr("page_id + 1000 AS page_id", "url", "html"))
    sizes = {}
    for file_bytes in (4_000, 12_000, warc.FILE_BYTES):
        folder = f"{tmp_path}/{file_bytes}"
        warc.write_archives(pages.coalesce(1), folder, file_bytes=file_bytes)
        got = warc.read_archives(spark, folder).collect()
        assert Counter(r.page_id for r in got) == Counter([*range(300), *range(1000, 1020)])
        assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(1000 + i, i) for i in range(20)}
        sizes[file_bytes] = [f.stat().st_size for f in Path(folder).glob("part-*")]
    dictionary = warc.DICTIONARY_BYTES
    assert len(sizes[4_000]) > len(sizes[12_000]) > 1
    assert all(max(found) < 2 * size + dictionary for size, found in sizes.items())
    for n in (1, 2, 3):  # every part of a file is given to it, whatever a sample holds
        records = [warc.record(i, None, bytes([i]) * 50, 50, "00", None) for i in range(40)]
        made = [p + b"\n" for p in warc.archives(iter(records), n, flush_bytes=1_000)]
        files = [b"".join(made[i:i + n]) for i in range(0, len(made), n)]
        assert [r for f in files for r in warc.read_archive(f)] == records and len(files) > 1


# ---- URL filter

def test_longest_rule_wins(spark):
    rules = [("org", "/", "block"), ("a.org", "/", "allow"), ("a.org", "/x/y", "block"), ("a.org", "/x/", "allow"), ("a.org", "/x/yy/z", "allow"),
             ("b.a.org", "/q", "block"), ("a.org", "/x/", "block"), ("com", "", "block")]
    urls = ["http://org/", "http://a.org/", "http://a.org/x/", "http://a.org/x/yx", "http://b.a.org/x/yy/z1", "http://b.a.org/q/x", "http://za.org/x/",
            "http://c.com", "http://com.net/", None, "http://b.a.org/x/yy"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")

    def brute(url):
        if url is None:
            return None
        host, _, path = url.split("://")[1].partition("/")
        path = "/" + path if _ else ""
        fit = [(h.count("."), len(p), v == "block", h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2:] if fit else None
    for block in (100, 1, 3):
        got = {r.url: (r.verdict == "block", r.rule) if r.rule else None for r in url_filter.judge_urls(pages, rules, block_rules=block).collect()}
        assert got == {u: brute(u) for u in urls}
    assert {r.verdict for r in url_filter.judge_urls(pages, [], default="block").collect()} == {"block"}


# ---- models

def test_language_backoff(spark):
    docs = spark.createDataFrame([(i, t, g) for i in range(20) for t, g in [("the house is red", "en"), ("das haus ist rot", "de")]], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.langs == ["de", "en"]
    seen, unseen = model.vector("haus"), model.vector("hauses")
    assert seen[0] > seen[1] and unseen[0] > unseen[1] and model.vector("çççç")[0] == model.vector("çççç")[1]
    small = langid.fit(docs, known=3)
    assert all(len(k) <= 3 for k in small.known)
    found = langid.predict(spark.createDataFrame([("Das Haus", 1), ("THE HOUSE", 2), ("12 !", 3), (None, 4)], "text string, score int"), model)
    assert [(r.lang_pred) for r in found.collect()] == ["de", "en", "und", "und"]


def test_rare_language_keeps_its_words(spark):
    """50,000 words of one language, twice each, push none of another one out."""
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    many = [" ".join(letters(i) for i in range(a, a + 500)) for a in range(0, 50_000, 500)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(many + many)] + [(900, "zweiundzwanzig häuser", "de")],
                                 "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.known[0]) == 50_002
    assert {"zweiundzwanzig", "häuser"} <= set(model.known[0]) and "<häus" in model.known[5]


def test_fit_sample_is_bounded_and_has_rare_labels(spark):
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    rows = [(None if i % 2 else i, letters(i), "en") for i in range(4000)] + [(None, "same", "en")] * 2000
    rows += [(5000 + i, letters(5000 + i), "de") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, fit_docs=100)
    assert model.langs == ["de", "en"] and 40 <= len(model.known[0]) <= 160
    labels = spark.createDataFrame([(i, 1) for i in range(0, 4000, 2)] + [(5000 + i, 0) for i in range(5)], "doc_id long, quality int")
    assert quality.fit(docs, labels, fit_docs=50) is not None


def test_ranking_separates():
    good = [quality.features(f"A plain sentence number {i}, with words that differ. It goes on.".encode()) for i in range(50)]
    bad = [quality.features((f"spam{i}!! " * 30).encode()) for i in range(20)]
    ranking = quality.learn(np.array(good + bad), np.array([1] * 50 + [0] * 20))
    assert ranking.raw(np.array(good)).min() > ranking.raw(np.array(bad)).max()
    assert quality.learn(np.array(good), np.ones(50)) is None
    assert quality.features(b"") == quality.features(None) == [0.0] * len(quality.FEATURES)


@pytest.mark.parametrize("n", [7919, 2 * 7919])
def test_ranking_meets_every_good_document(n):
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 0.3, (n, 3)), rng.normal(-1, 0.3, (700, 3))
    good[::7919] = -9  # odd ones
    ranking = quality.learn(np.concatenate((good, bad)), np.repeat([1, 0], (n, 700)))
    assert np.median(ranking.raw(good)) > np.median(ranking.raw(bad))


def test_keep_good_agrees_with_scores(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality.scores(docs, labels).collect() if r.score >= quality.KEEP}
    assert {r.doc_id for r in kept.collect()} == want
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()


# ---- mixing

def test_targets_are_the_water_level(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 0, None: 3000}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted((s for s in sizes if s), key=str.encode) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, free, want = sum(sizes.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            break
        for s in above:
            want[s] = 3 * sizes[s]
            left -= want[s]
        free -= above
    assert got == pytest.approx(want | share)


@pytest.mark.parametrize("cell_rows", [10_000, 7])
def test_mix_comes_near_its_targets(spark, cell_rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = mixing.with_copies(docs, cell_rows=cell_rows)
    for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= 3 * r.most
    assert found.where("taken > 3 * size").count() == 0
    mixed = mixing.mix(docs, cell_rows=cell_rows)
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.copies for r in found.where("copies > 0").collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want


def test_mix_does_not_depend_on_its_cells(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    view = lambda n: sorted(map(str, mixing.with_copies(docs, keep=["doc_id", "size"], cell_rows=n).collect()))
    assert view(2) == view(10_000)


# ---- sketches

def test_sketches_merge_and_compare():
    codes = text.WordCodes()
    words = [f"w{i}" for i in range(3000)]
    whole, part = " ".join(words).encode(), " ".join(words[:300]).encode()
    a, b = sketch.sketch(whole, codes), sketch.sketch(part, codes)
    halves = [sketch.sketch(" ".join(x).encode(), codes) for x in (words[:1504], words[1500:])]
    assert (sketch.merge(*halves) == a).all()
    assert sketch.containment(b, a) == 1.0 and sketch.containment(a, b) == pytest.approx(0.1, abs=0.05)
    assert (sketch.decode(sketch.encode(a)) == a).all() and len(sketch.decode("")) == 0
    none = sketch.sketch(b" ", codes)
    assert sketch.containment(none, none) == 1.0 and sketch.containment(none, a) == 0.0 and sketch.containment(a, none) == 0.0


def test_ranges_do_not_change_the_next_document(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    view = lambda n: sorted(map(str, sketch.against_next(docs, range_bytes=n).collect()))
    assert view(50_000) == view(1 << 30)
    assert sorted(r.fingerprint for r in sketch.sketches(docs).collect()) == sorted(r.fingerprint for r in sketch.against_next(docs).collect())
