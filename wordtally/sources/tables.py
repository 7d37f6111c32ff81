"""Driver tables and the announcement view built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtally.functions import text as T
from wordtally.operators.joins import broadcast_limit

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

BASE_DATE = "2010-01-01"
DATE_SPAN = 90


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Text work is CPU-bound per row: a small table that arrives in fewer
    splits than there are cores is hash-spread by its key first. A large table
    already has more splits than cores and is left as read (no shuffle)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    return df


def class_label(quality: F.Column) -> F.Column:
    return F.when(quality == 1, "pos").when(quality == 0, "neg").otherwise("none")


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text`` of every document, for steps that need no label: nothing is joined, so no text is shuffled."""
    return spread(read_table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("id"), "text")


def may_have_label(docs: DataFrame, labels: DataFrame, labelled: bool) -> DataFrame:
    """``docs`` without those that have only rows without a label (``labelled``) or only rows with one, so that no text is
    tokenized in vain. The ids are broadcast behind the check of their number; above the limit every document stays."""
    has = F.coalesce(F.col("quality").isin(0, 1), F.lit(False))
    per_doc = labels.groupBy("doc_id").agg(F.max(has).alias("some"), F.min(has).alias("all"))
    ids = per_doc.where("some" if labelled else "`all`").select("doc_id")
    if ids.count() > broadcast_limit(labels):
        return docs
    return docs.join(F.broadcast(ids), "doc_id", "left_semi" if labelled else "left_anti")


def announcements(spark: SparkSession, sf_dir: str, labelled: bool | None = None) -> DataFrame:
    """The document registry as the reference keeps it, one row per document.

    ``labelled`` says that the caller keeps only rows with, or only rows without a class label: most texts of the others
    are then left out before they are tokenized. The caller still filters by ``class_label``.

    symbol = source, date = base + doc_id mod 90, label from quality
    (missing -> ``none``), cost = 1 + toxic, gain = n_chars / 1000, content hash
    of the text, ``seq`` = the order in which documents arrive.
    """
    labels = read_table(spark, sf_dir, "labels")
    read = read_table(spark, sf_dir, "documents")
    docs = spread(read if labelled is None else may_have_label(read, labels, labelled), "doc_id").select(
        "doc_id",
        "source",
        "n_chars",
        "text",
        # taken where the text is read, so that a step that needs these alone shuffles no text to the labels
        F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).alias("orig_md5"),
        T.sentence_count("text").alias("sentences"),
        T.words("text").alias("words"),
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("symbol"),
        F.date_add(F.lit(BASE_DATE).cast("date"), F.pmod(F.col("doc_id"), F.lit(DATE_SPAN)).cast("int")).alias(
            "associated_date"
        ),
        class_label(F.col("quality")).alias("class_label"),
        (F.lit(1.0) + F.coalesce(F.col("toxic"), F.lit(0))).cast("double").alias("error_cost"),
        (F.col("n_chars") / 1000.0).alias("success_gain"),
        "text",
        "orig_md5",
        F.col("doc_id").alias("seq"),
        "sentences",
        "words",
    )


def tokenized(ann: DataFrame, keep_sentences: bool = False) -> DataFrame:
    """Per-document tokenized rows (the reference's tokenized table before merging).

    ``tokens`` is the flat token list; ``text_tokenized`` (sentences of tokens)
    is added only when asked for, since every downstream step works on the
    flat list.
    """
    cols = [
        "id",
        "symbol",
        "class_label",
        "error_cost",
        "success_gain",
        "associated_date",
        "sentences",
        "words",
    ]
    if keep_sentences:
        cols.append(T.sentence_words("text").alias("text_tokenized"))
    return ann.select(*cols).withColumn("tokens", F.size("words"))


_SELECTIONS: dict = {}


def labelled_selection(spark: SparkSession, sf_dir: str, min_sentences: int = 1) -> DataFrame:
    """F1 with the full date range and all symbols: labelled documents with
    their tokens, written once to the checkpoint folder (the reference keeps
    the same table on disk) and read by every later step instead of running
    the tokenizer again."""
    from wordtally.operators.registry import select_docs
    from wordtally.session import reliable_checkpoint

    key = (spark.sparkContext.applicationId, sf_dir, min_sentences)
    if key not in _SELECTIONS:
        sel = select_docs(tokenized(announcements(spark, sf_dir, labelled=True)), min_sentences=min_sentences)
        _SELECTIONS[key] = reliable_checkpoint(sel.drop("text"))
    return _SELECTIONS[key]


def clear_cache() -> None:
    _SELECTIONS.clear()
