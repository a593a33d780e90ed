"""corpus_pipeline.run, stage by stage, against versions of the stages that
don't use the operators."""

from collections import Counter
from pathlib import Path

import brute
import duckdb
import pytest

import corpus_pipeline
from basketry.llm import quality
from basketry.llm.queries import ORACLES, QUERIES, tokenizer_path
from basketry.session import checkpoint_dir

SMALL = "/root/testdata/sf0.001"


def stages(spark, folder):
    """Rows of the documents and of every stage of one run."""
    place = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(place.glob("pipeline-*"))
    out = corpus_pipeline.run(spark, folder)
    made, = set(place.glob("pipeline-*")) - before
    tables = [spark.read.parquet(f"{folder}/documents.parquet"), *(spark.read.parquet(f"{made}/{name}") for name, _ in corpus_pipeline.STAGES)]
    assert sorted(map(str, out.collect())) == sorted(map(str, tables[-1].collect()))
    return tables


def in_duckdb(text, docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SMALL}/benchmark.parquet')")
    relation = con.sql(text)
    return [dict(zip(relation.columns, row)) for row in relation.fetchall()]


def test_every_stage_on_the_fixture(spark):
    from tokenizers import Tokenizer

    docs, good, distinct, clean, mixed, tokens = stages(spark, SMALL)
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    scores = {r.doc_id: r.score for r in QUERIES["op8_quality"](spark, SMALL).collect()}
    assert ids(good) == Counter(d for d in ids(docs) if scores[d] >= quality.KEEP) and 0 < good.count() < docs.count()
    found = brute.simhash([tuple(r) for r in good.select("doc_id", "text").collect()])
    assert ids(distinct) == Counter({c for _, _, c in found}) and distinct.count() < good.count()
    assert ids(clean) == Counter(r["doc_id"] for r in in_duckdb(ORACLES["op4_decontaminate"], distinct) if not r["contaminated"])
    assert clean.count() < distinct.count()
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in in_duckdb(ORACLES["op9_mix"], clean) if r["size"]}
    copies = ids(mixed)
    assert {d: copies[d] for d in taken} == taken and max(copies.values()) > 1
    tokenizer = Tokenizer.from_file(tokenizer_path())
    text = dict(map(tuple, docs.select("doc_id", "text").collect()))
    want, start = [], 0
    for d in sorted(copies.elements()):
        n = len(tokenizer.encode(text[d] or "", add_special_tokens=False).ids) + 1
        want.append((d, start, n))
        start += n
    assert [tuple(r) for r in tokens.select("doc_id", "start", "n_tokens").orderBy("start").collect()] == want


@pytest.mark.parametrize("name", ["edge", "empty"])
def test_odd_and_empty_tables(spark, request, name):
    tables = stages(spark, request.getfixturevalue(name))
    for before, after in zip(tables, tables[1:-1]):
        assert after.columns == before.columns
        assert set(map(str, after.collect())) <= set(map(str, before.collect()))
    assert tables[-1].count() == tables[-2].count()
    assert tables[-1].count() == 0 if name == "empty" else tables[-1].count() > 0
