"""Document files.

``binaryFile`` scans give (path, modificationTime, length, content); the
type comes from the extension (S4), the content hash from the bytes (G19),
the text from the type: txt decoded as UTF-8, html through X15. PDF text
extraction is not built: such rows carry an error instead of text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtally.functions.cells import file_type, fix_apostrophes
from wordtally.functions.html import html_block, html_block_by, html_to_text


# Input extensions of the predict step.
SAMPLE_EXTENSIONS = ("pdf", "htm", "html", "text", "txt")
MODEL_EXTENSION = "pickle"


def split_inputs(paths: list[str], model_extension: str = MODEL_EXTENSION) -> tuple[list[str], list[str]]:
    """Tell sample files from model folders by extension (after the last
    dot, lower-cased); a name without extension or with another one rejects
    the whole run, as in the reference."""
    import re

    samples, models = [], []
    for p in paths:
        m = re.search(r"\A.*\.(.+)\Z", p.strip())
        if not m:
            raise ValueError(f"cannot tell the format of {p!r}: no extension")
        ext = m.group(1).lower()
        if ext in SAMPLE_EXTENSIONS:
            samples.append(p)
        elif ext == model_extension:
            models.append(p)
        else:
            raise ValueError(f"{p!r}: unsupported file type")
    return samples, models


def scan_files(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """``path, file_type, length, orig_md5, content``."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root)
    return df.select("path", file_type(F.col("path")).alias("file_type"), "length", F.md5("content").alias("orig_md5"), "content")


def to_text(df: DataFrame, block_tag: str | None = None, keep: list[str] = ()) -> DataFrame:
    """``path, file_type, text, error`` from scanned files (or any
    frame with ``path, file_type`` and ``content`` or ``raw`` text). A per-row
    ``xpath`` column (a tag name) selects the block of each html row; else
    ``block_tag`` applies to all. ``keep`` names further columns to pass on."""
    raw = F.col("raw") if "raw" in df.columns else F.decode(F.col("content"), "UTF-8")
    if "xpath" in df.columns:
        html = html_block_by(raw, F.col("xpath"))
    else:
        html = html_block(raw, block_tag) if block_tag else html_to_text(raw)
    text = (
        F.when(F.col("file_type") == "txt", fix_apostrophes(raw))
        .when(F.col("file_type") == "html", fix_apostrophes(html))
    )
    err = (
        F.when(F.col("file_type") == "pdf", F.lit("pdf text extraction is not built"))
        .when(~F.col("file_type").isin("txt", "html"), F.lit("unsupported file type"))
    )
    more = [c for c in keep if c not in ("path", "file_type")]
    return df.select("path", "file_type", text.alias("text"), err.alias("error"), *more)


def write_texts(texts: DataFrame, out: str, mode: str = "errorifexists") -> None:
    """K9 sink: one Parquet table of converted texts (failures kept with their error)."""
    texts.write.mode(mode).parquet(out)
