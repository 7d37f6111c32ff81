"""Spark session defaults and the reliable checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.driver.memory": "16g",
}


def local_session(cores: int | str = "*", app: str = "wordtally", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark (a cluster brings its own)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**_LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, taking it from the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only a local master without the setting (tests, the benchmark) gets a
    fresh folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    local_dir = tempfile.mkdtemp(prefix="wordtally-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


def reliable_checkpoint(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table below the checkpoint folder and read it back.

    Used for results that several later steps read (the tokenized selection,
    the dictionary, ranked tables). It cuts lineage, so a lost executor only
    rereads files, and unlike row files of an RDD checkpoint the table lets
    each reader prune columns and push filters down. ``schema`` names another
    type to read the columns as (that of a vector whose stored form was written).
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def drop_checkpoints(*tables: DataFrame) -> None:
    """Delete tables of ``reliable_checkpoint`` that no later step reads, and let the context cleaner remove the
    shuffle files of steps that ended (it follows the collections of garbage, which a driver with little to do puts off)."""
    for table in tables:
        jvm, jsc = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc
        for folder in {os.path.dirname(f) for f in table.inputFiles()}:
            of = jvm.org.apache.hadoop.fs.Path(folder)
            of.getFileSystem(jsc.hadoopConfiguration()).delete(of, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application).

    The package is zipped beside the driver and handed to Spark's own file
    distribution, so kernels run wherever an executor starts, whatever its
    working folder or ``PYTHONPATH``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(package)
    target = os.path.join(tempfile.mkdtemp(prefix=f"{name}-ship-"), f"{name}_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, package)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
