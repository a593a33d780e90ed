"""A corpus from raw documents to token files in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs; all but the last
return the columns of ``documents``.

1. quality: documents that the classifier rejects go.
2. simhash: one document of each group of near-duplicates stays.
3. decontaminate: documents that hold a passage of a benchmark item go.
4. mix: sources are brought to their target weights; a document stays out
   or is there one to three times.
5. tokens: token files are written and read back, a row per document.

No stage fails on an empty table: the next one gets its columns without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import decontam, mixing, quality, simhash
from basketry.llm.queries import token_output
from basketry.llm.store import prepare_session, shared_folder
from basketry.session import configure


def _started(spark: SparkSession) -> SparkSession:
    configure(spark)
    prepare_session(spark)
    return spark


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _started(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _started(spark)
    return simhash.keep_first(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_documents(docs, _started(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _started(spark)
    return mixing.mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output(_started(spark), docs)


STAGES = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]

#: SimHash and the tokenizer can't be said in SQL.  tests/llm/test_pipeline.py
#: holds every stage of a run against a version without the operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _started(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
