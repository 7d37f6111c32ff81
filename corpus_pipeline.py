"""Corpus pipeline: five stages from raw documents to packed token windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again for the next one. All stages but the last return the
columns of ``documents``.

1. quality rules: documents that the rules reject go;
2. SimHash near-dedup: one document of each group stays, the one with the smallest id;
3. substring dedup: repeated windows of words leave the text (a text that loses
   nothing stays as it is; a document that loses every word goes);
4. secret scans: secrets are masked in the text;
5. packing: the pieces of all texts and their places in windows.

``ORACLE_SQL`` is None: the forest of stage 4 and the tokenizer and least squares
of stage 5 have no SQL form. ``tests/llm/test_models_and_pages.py`` holds the result
against brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtally.llm import packing, quality_rules, secrets, simhash, substring_dedup
from wordtally.llm.common import Work, table
from wordtally.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DDL = "text string, lang string, source string, n_chars long"

ORACLE_SQL = None


def _plain(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_plain(docs), Work(spark), DDL).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(_plain(docs), Work(spark)).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d = substring_dedup.deduplicate(_plain(docs), Work(spark), DDL, with_text=True)
    d = d.where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return d.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask(_plain(docs), Work(spark))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(_plain(docs), Work(spark), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", drop_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("secret scans", mask_secrets),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    work = Work(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.store(stage(spark, docs, sf_dir), f"stage_{k}")
    return docs
