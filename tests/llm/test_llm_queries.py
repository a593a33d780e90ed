"""Each registered query on tables of odd rows, on empty tables and on the
small fixture, against its DuckDB text or a brute-force version."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import brute
import duckdb
import numpy as np
import pytest

from basketry.llm import langid, quality, sketch, toxicity
from basketry.llm.queries import ORACLES, QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"


#: The rows of a query on a folder: each query runs once a folder.
RESULTS: dict = {}


def result(spark, folder, name):
    if (name, folder) not in RESULTS:
        df = QUERIES[name](spark, folder)
        RESULTS[name, folder] = df.columns, df.collect()
    return RESULTS[name, folder]


def rows(spark, folder, name, *columns):
    names, found = result(spark, folder, name)
    return Counter(tuple(r[c] for c in columns or names) for r in found)


def documents(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(params=["edge", "small", "empty"])
def folder(request):
    return SMALL if request.param == "small" else request.getfixturevalue(request.param)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if Path(path).is_file() else path + '/*.parquet'}')")
    want = con.sql(ORACLES[name])
    assert sorted(result(spark, folder, name)[0]) == sorted(want.columns)
    assert rows(spark, folder, name, *want.columns) == Counter(want.fetchall())


def test_op1_equals_brute_force(spark, folder):
    assert rows(spark, folder, "op1_simhash") == Counter(brute.simhash(documents(spark, folder)))


def test_op2_equals_brute_force(spark, folder):
    assert rows(spark, folder, "op2_substring") == Counter(brute.repeats(documents(spark, folder)))


def test_op3_equals_the_tokenizer(spark, folder):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want, start = [], 0
    for d, t in sorted(documents(spark, folder), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(spark, folder, "op3_tokens") == Counter(want)


def test_op6_on_labelled_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = result(spark, folder, "op6_langid")[1]
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    texts = {}
    for d, t in documents(spark, folder):
        texts.setdefault(d, set()).add(any(c.isalpha() for c in t or ""))
    assert all((r.lang_pred == langid.UNKNOWN) == (texts[r.doc_id] == {False}) for r in got if len(texts[r.doc_id]) == 1)
    if folder == SMALL:
        lang = dict(map(tuple, docs.select("doc_id", "lang").collect()))
        assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.97


def test_op8_on_labelled_rows(spark, folder):
    got = result(spark, folder, "op8_quality")[1]
    assert len(got) == len(documents(spark, folder))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= quality.KEEP) for r in got)
    if folder == SMALL:
        label = dict(map(tuple, spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()))
        assert np.mean([r.predicted == label[r.doc_id] for r in got if r.held_out and r.doc_id in label]) > 0.9


def test_op10_equals_brute_force(spark, folder):
    want = [(d, n, hashlib.sha256(text.encode()).hexdigest(), brute.fingerprint(text)) for d, n, text, _ in brute.edited(documents(spark, folder))]
    got = result(spark, folder, "op10_sketch")[1]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((d, brute.fingerprint(t or "")) for d, t in documents(spark, folder))
    assert rows(spark, folder, "op10_sketch", "doc_id", "n_chars", "edited_sha256", "edited_fingerprint") == Counter(want)
    if folder != SMALL:
        return
    texts = {d: t for d, t in documents(spark, folder)}
    near = {d: (own & brute.shingles(x), own & brute.shingles(y), own) for d, _, x, y in brute.edited(list(texts.items())) for own in [brute.shingles(texts[d])]}
    # off by the error of a sample of that many hashes, and little on average
    found = [(abs(r.near_edited - len(near[r.doc_id][0]) / len(near[r.doc_id][2])), abs(r.near_next - len(near[r.doc_id][1]) / len(near[r.doc_id][2])))
             for r in got if r.fingerprint]
    kept = np.array([len(sketch.decode(r.fingerprint)) for r in got if r.fingerprint])
    assert np.mean(found, axis=0).max() < 0.05 and (np.max(found, axis=1) < 4 * np.sqrt(0.25 / kept)).all()
    assert np.max(np.array(found)[kept >= 64]) < 0.2
    # only very short texts are without a hash
    assert all(r.fingerprint for r in got if len(near[r.doc_id][2]) >= 16)


def test_op12_on_labelled_rows(spark, folder):
    got = result(spark, folder, "op12_toxicity")[1]
    texts = documents(spark, folder)
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in texts)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.TOXIC) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    wordless = {d for d, t in texts if not toxicity.tokens((t or "").encode())}
    assert all(r.score == 0 for r in got if r.doc_id in wordless and r.doc_id not in {d for d, t in texts if toxicity.tokens((t or "").encode())})


@pytest.mark.parametrize("name", ["op6_langid", "op8_quality", "op9_mix", "op10_sketch", "op11_hard_negatives", "op12_toxicity", "op13_search"])
def test_reruns_agree(spark, edge, name):
    assert rows(spark, edge, name) == Counter(map(tuple, QUERIES[name](spark, edge).collect()))
