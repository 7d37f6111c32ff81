"""Sinks (K1-K8): every stage output is a Parquet table or a ``;`` CSV.

``replace=False`` is the reference's guard against overwriting (K7): the write
fails when the target exists; ``replace=True`` overwrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtally.functions.cells import file_type


def _mode(replace: bool) -> str:
    return "overwrite" if replace else "errorifexists"


def write_table(df: DataFrame, path: str, replace: bool = False, partition_by: list[str] | None = None) -> None:
    """K1 / K3: registry, tokenized table or samples as Parquet (a new snapshot per run)."""
    w = df.write.mode(_mode(replace))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_tokenized(tok: DataFrame, path: str, replace: bool = False) -> None:
    """K1 for the tokenized table, partitioned by date so that the date range
    of a selection (F1) prunes whole folders."""
    write_table(tok, path, replace, partition_by=["associated_date"])


def write_samples(feats: DataFrame, dictionary_ids: DataFrame, path: str, ids: DataFrame, replace: bool = False,
                  size: int | None = None, transformation: str | None = None) -> None:
    """K3: the samples matrix in long form with the dictionary mark, the
    vector size and the transformation's path. ``ids`` are the documents of
    the selection: one without any dictionary word keeps a row with a null
    index, so every document can be read back."""
    marks = dictionary_ids.select("id", F.lit(True).alias("in_dictionary"))
    rows = ids.select("id").distinct().join(feats, "id", "left")
    out = rows.join(marks, "id", "left").withColumn("in_dictionary", F.coalesce("in_dictionary", F.lit(False)))
    out = out.withColumn("size", F.lit(size).cast("long")).withColumn("transformation", F.lit(transformation).cast("string"))
    write_table(out, path, replace)


def read_samples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S8 of a K3 table: (values ``id, idx, value``, documents ``id, in_dictionary, size, transformation``)."""
    t = spark.read.parquet(path)
    docs = t.select("id", "in_dictionary", "size", "transformation").distinct()
    return t.where(F.col("idx").isNotNull()).select("id", "idx", "value"), docs


def write_dictionary_report(model, path: str, replace: bool = False) -> None:
    """K5: the report rows in dictionary order plus the two header facts
    (dictionary length, documents processed) as a one-row table beside them."""
    rows = model.report().orderBy("idx").select(
        F.col("word").alias("Word"),
        F.col("argument_for").alias("Argument for"),
        F.col("pos_count").alias("pos count"),
        F.col("neg_count").alias("neg count"),
        F.col("pos_idf").alias("pos idf"),
        F.col("neg_idf").alias("neg idf"),
    )
    rows.write.mode(_mode(replace)).option("sep", ";").option("header", True).csv(f"{path}/words")
    model.report_facts().coalesce(1).write.mode(_mode(replace)).option("sep", ";").option("header", True).csv(f"{path}/facts")


def store_contents(files: DataFrame, registry: DataFrame, path: str, replace: bool = False) -> None:
    """K8: each accepted content once, under its hash: ``(orig_md5, file_type,
    content)`` for the hashes of registry rows that keep a stored copy."""
    keep = registry.where(F.col("use_saved")).select("orig_md5").distinct()
    # the path of each kept hash first, then its bytes by path: no content goes through the aggregation
    one = files.select("orig_md5", "path").join(keep, "orig_md5", "left_semi").groupBy("orig_md5").agg(F.min("path").alias("path"))
    out = files.join(one.select("path"), "path", "left_semi").select("orig_md5", file_type(F.col("path")).alias("file_type"), "content")
    write_table(out, path, replace)
