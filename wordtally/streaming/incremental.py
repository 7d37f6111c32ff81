"""Incremental ``import``: new manifest files -> append-only import log -> registry.

The reference imports manifests one run at a time and skips what it has
seen. Here a Structured Streaming file source watches the manifest folder;
each micro-batch (files are tracked by the query's checkpoint) checks the
headers of its new files (S2), unpivots the rows (S3), joins them to the
scanned document files (F13, G19) and writes them to the batch's folder of the
import log with their order ``seq = batch << 40 | dense row``; a replayed batch
overwrites its folder. The registry is a view over the whole log: the
same order-aware aggregation as a batch import (G2), so replaying the log
always yields the same registry and a lost executor only reruns its batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtally.operators import registry as R
from wordtally.operators.ranking import dense_index
from wordtally.sources import manifest as M

LOG_COLUMNS = ["id", "seq", "orig_md5", "symbol", "associated_date", "class_label", "error_cost", "success_gain",
               "original_url", "path_saved", "file_type", "use_saved", "xpath", "modify", "status_file"]


def _batch_writer(spark: SparkSession, files: DataFrame, log_path: str, modify: bool, store_content: bool):
    def write(batch: DataFrame, epoch: int) -> None:
        rows, _ = M.parse_lines(batch)
        rows = M.unpivot(M.typed(rows))
        order = [F.col("file"), F.col("_block"), F.col("_line"), F.col("slot")]
        rows = dense_index(rows, order, idx_col="idx")
        seq = F.lit(int(epoch)).cast("long") * F.lit(1 << 40) + F.col("idx")
        man = rows.select(
            seq.alias("seq"),
            F.col("code").alias("symbol"),
            F.col("date").alias("associated_date"),
            "class_label",
            "error_cost",
            "success_gain",
            F.col("path").alias("original_url"),
            F.col("file").alias("status_file"),
        ).withColumn("id", F.col("seq"))
        inc = R.incoming_rows(man, files, store_content).withColumn("xpath", F.lit(None).cast("string"))
        out = inc.withColumn("modify", F.lit(bool(modify))).select(*LOG_COLUMNS)
        # a folder of its own for each batch: a replayed batch replaces what it wrote before
        out.write.mode("overwrite").parquet(os.path.join(log_path, f"epoch={int(epoch)}"))

    return write


def import_stream(
    spark: SparkSession,
    manifest_dir: str,
    files: DataFrame,
    log_path: str,
    modify: bool = False,
    store_content: bool = True,
    checkpoint: str | None = None,
):
    """Process every manifest not seen before (``availableNow``) and return
    the finished streaming query. ``files(path, orig_md5)`` are the scanned
    document files. ``checkpoint`` is the stream's own folder in shared
    storage: it must stay the same from run to run and belong to one manifest
    folder and log."""
    if not checkpoint:
        raise ValueError("name the stream's checkpoint folder: it remembers which manifests were imported")
    stream = M.manifest_lines(spark.readStream.format("text").load(manifest_dir))
    q = (
        stream.writeStream.foreachBatch(_batch_writer(spark, files, log_path, modify, store_content))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def registry_view(log: DataFrame) -> DataFrame:
    """G2 over the whole log: the first row of a hash fixes the stored copy;
    the labels come from the last row that was imported with ``modify`` (or
    from the first row when none was)."""
    first = log.groupBy("orig_md5").agg(F.min("seq").alias("_first"))
    counted = log.join(first, "orig_md5").where((F.col("seq") == F.col("_first")) | F.col("modify"))
    return R.upsert(None, counted.drop("_first", "modify", "status_file", "epoch"), modify=True)
