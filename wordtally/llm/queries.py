"""The queries of the training-data operators; SQL twins, where SQL can state the result, are in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtally.llm.common import Work, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordtally.llm import quality_rules

    return quality_rules.judge(table(spark, sf_dir, "documents"), Work(spark))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordtally.llm import simhash

    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), Work(spark))
    return out.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordtally.llm import substring_dedup

    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"), Work(spark))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from wordtally.llm import byte_bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from wordtally.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), Work(spark), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordtally.llm import quality_pu

    return quality_pu.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Work(spark))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordtally.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, *toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordtally.llm import secrets

    return secrets.scan(table(spark, sf_dir, "documents"), Work(spark))


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordtally.llm import vamana

    return vamana.nearest(table(spark, sf_dir, "embeddings"), Work(spark))


@query
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordtally.llm import html_wrapper

    return html_wrapper.extract(table(spark, sf_dir, "pages"), Work(spark))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordtally.llm import lexical

    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Work(spark))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordtally.llm import merkle

    return merkle.manifest(table(spark, sf_dir, "documents"), Work(spark))


@query
def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordtally.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), Work(spark))


def oracle_sql() -> dict[str, str]:
    from wordtally.llm import oracles

    return dict(oracles.ORACLE)
