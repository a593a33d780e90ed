"""The registered queries opN_<name> (one per operator, over its whole table,
with production parameters) and their DuckDB texts where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import decontam, langid, mixing, negatives, quality, search, simhash, sketch, substring, tokens, toxicity, url_filter, warc
from basketry.llm.oracle import ORACLES  # noqa: F401
from basketry.llm.store import prepare_session, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components_of(_table(spark, sf_dir, "documents"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = substring.remove_repeats(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_output(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Token files of ``docs``, read back: a row per document."""
    folder = shared_folder(spark, "tokens")
    tokens.write_tokens(docs, folder, tokenizer_path())
    return tokens.with_starts(tokens.read_tokens(spark, folder)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, _table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_hits(docs, _table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("hits.items", lambda i: i.cast("string")))
    found = found.select("doc_id", "hits", F.expr(f"CAST({decontam.n_hit()} AS BIGINT)").alias("n_hit"), ids.alias("ids"))
    return found.select("doc_id", F.col("hits.n_words").alias("n_words"), "n_hit", F.size("ids").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    found = warc.read_archives(spark, folder, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.CONTRACT_RULES).drop("url")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.scores(docs, _table(spark, sf_dir, "labels"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "score",
                        (F.col("score") >= quality.KEEP).cast("int").alias("predicted"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_copies(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.against_next(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").where(negatives.finite("embedding"))
    moved = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    label = F.when(moved, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), negatives.quantised("embedding").alias("vec"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    network = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.scores(docs, network)
    return found.select("doc_id", langid.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_substring, op3_tokens, op4_decontaminate, op5_warc,
    op6_langid, op7_url_filter, op8_quality, op9_mix, op10_sketch, op11_hard_negatives, op12_toxicity, op13_search)}
