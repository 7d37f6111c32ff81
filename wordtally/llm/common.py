"""Shared helpers of the training-data operators: tables, work folders, Arrow row batches, exact integer sketches."""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtally.session import ensure_checkpoint_dir, ship_package

#: Rows handed to a Python kernel at once, whatever the size of an Arrow batch.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Work:
    """A folder of intermediate Parquet tables below ``spark.checkpoint.dir``.

    A written table cuts lineage: a lost executor only rereads it. ``drop``
    deletes a table that no later step reads and lets Spark's cleaner remove
    the shuffle files of frames that are gone.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}  # of the table last stored under each name
        self.stored = 0

    def store(self, df: DataFrame, name: str) -> DataFrame:
        self.stored += 1
        path = self.paths[name] = f"{self.root}/{self.stored}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.release()

    def release(self) -> None:
        """Collect driver garbage, so that Spark's context cleaner frees shuffle files nobody refers to."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in zero-copy slices of a few rows, so that Python lists stay small beside long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` of a function on column lists; ``schema`` is Spark DDL."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            out = fn(part.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def ddl_names(ddl: str) -> list[str]:
    """Column names of a Spark DDL string, none for an empty one."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).names if ddl else []


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def in_training_fold(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def bucket_of(value: Column) -> Column:
    """Bucket of a non-negative integer in a log-linear histogram: its lower edge.

    Below 256 a bucket holds one value; above, the leading 8 bits are kept
    (relative error below 1/128). Bucket counts add up whatever the order of
    merging, so the histogram is a mergeable and repeatable quantile sketch.
    """
    shift = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


#: Most bits of a table made by ``bit_table`` (32 MB).
MAX_BITS = 1 << 28


def bit_table(keys: DataFrame, key: str) -> np.ndarray:
    """One bit for each value (a 64-bit hash) of a column, modulo the size of the table.

    Built by a grouped ``bit_or``; the driver gets a word for each 64 bits at
    most, so the table is bounded and can be broadcast whatever the number of
    keys. A full table lets everything pass: it only spares work, an exact
    join has to follow.
    """
    wanted, bits = min(16 * keys.count(), MAX_BITS), 1 << 16
    while bits < wanted:
        bits <<= 1
    at = F.col(key).bitwiseAND(F.lit(bits - 1))
    word = F.call_function("bit_or", F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")))
    found = keys.groupBy(F.shiftright(at, 6).alias("at")).agg(word.alias("word")).toArrow()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[found["at"].to_numpy()] = found["word"].to_numpy()
    return table.view(np.uint64)


def in_bit_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.astype(np.int64) & (64 * len(table) - 1)
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
