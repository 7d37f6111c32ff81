"""Manifest files.

A manifest is a ``;``-separated UTF-8 CSV: a header row whose first six names
are fixed, then one row per symbol and date with one or more announcement
paths from the sixth column on.
"""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordtally.functions.cells import cell_date, cell_number, cell_text
from wordtally.operators.joins import checked_broadcast
from wordtally.session import reliable_checkpoint

# The manifest header, in order.
HEADER = ["Code", "Date", "Class Label", "Error Cost", "Success Gain", "Announcement"]
FIELDS = ["code", "date", "class_label", "error_cost", "success_gain"]


def wide_schema(max_paths: int) -> T.StructType:
    """An explicit wide schema; without it Spark takes the width from the
    first line and silently drops further paths."""
    return T.StructType(
        [T.StructField(f, T.StringType()) for f in FIELDS]
        + [T.StructField(f"path{i}", T.StringType()) for i in range(max_paths)]
    )


def header_matches(line: Column) -> Column:
    """The first six names, stripped, equal the fixed header in order."""
    names = F.transform(F.split(F.regexp_replace(line, "^\ufeff", ""), ";"), lambda c: F.btrim(c, F.lit(" \t\r\n\x0b\x0c")))
    return F.slice(names, 1, len(HEADER)) == F.array(*[F.lit(h) for h in HEADER])


def _plain_path(path: str) -> str:
    return unquote(re.sub("^[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?", "", path))


def _plain(file: Column) -> Column:
    """The same for the file names that a scan reports."""
    return F.url_decode(F.replace(F.regexp_replace(file, "^[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))


#: Place of a line: file, start of its block in the file, order within the block.
_PLACE = ["file", "_block", "_line"]


def manifest_lines(text: DataFrame) -> DataFrame:
    """Lines of a (batch or streaming) text scan with their file and block."""
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))


def parse_lines(lines: DataFrame, min_paths: int = 1) -> tuple[DataFrame, DataFrame]:
    """S1 + S2 over the lines of any number of files in one pass: (wide rows
    of the accepted files with their place, all files with ``ok``).

    Header and width come from one aggregation with a row per file, which
    stays a table; the width is that of the widest row, so no path cell is lost.
    """
    lines = lines.withColumn("_line", F.monotonically_increasing_id())
    place = F.struct("_block", "_line")
    cells = F.length("value") - F.length(F.replace(F.col("value"), F.lit(";"), F.lit(""))) + 1
    heads = lines.groupBy("file").agg(F.min_by("value", place).alias("head"), F.min(place).alias("at"), F.max(cells).alias("cells"))
    heads = reliable_checkpoint(heads.withColumn("ok", F.coalesce(header_matches(F.col("head")), F.lit(False))))
    widest = heads.where("ok").agg(F.max("cells")).first()[0] or 0
    schema = wide_schema(max(min_paths, widest - len(FIELDS)))
    first = heads.where("ok").select(F.col("file").alias("_f"), F.col("at._block").alias("_b"), F.col("at._line").alias("_l"))
    body = lines.join(checked_broadcast(first), F.col("file") == F.col("_f"))
    body = body.where(((F.col("_block") != F.col("_b")) | (F.col("_line") != F.col("_l"))) & (F.trim("value") != ""))
    row = F.from_csv("value", schema.simpleString()[len("struct<"):-1].replace(":", " "), {"sep": ";", "mode": "PERMISSIVE"})
    return body.select(*_PLACE, row.alias("r")).select("r.*", *_PLACE), heads.select("file", "ok")


def read_manifests(spark: SparkSession, paths: list[str], max_paths: int = 1) -> tuple[DataFrame, list[str]]:
    """S1 + S2: the accepted files as wide rows with their file name and
    ``seq``, the dense order (file position in the list, row order) in which
    the reference processes rows. One scan reads all files; the width is that
    of the widest row (``max_paths`` is only a least width). A file belongs to
    the first of ``paths`` that is the file or a folder above it, found by a
    join on the folders of its name. Returns (rows, rejected of ``paths``)."""
    from wordtally.operators.ranking import dense_index

    rows, files = parse_lines(manifest_lines(spark.read.text(paths)), max_paths)
    plain = [_plain_path(p if "://" in p or p.startswith(("/", "file:")) else os.path.abspath(p)).rstrip("/") for p in paths]
    given = spark.createDataFrame([(f, i, p) for i, (f, p) in enumerate(zip(plain, paths))], "_plain string, _pos long, _name string")
    parts = F.split(_plain(F.col("file")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    of = files.where("ok").select(F.col("file").alias("_f"), F.explode(above).alias("_plain")).join(checked_broadcast(given, len(paths)), "_plain")
    of = reliable_checkpoint(of.groupBy("_f").agg(F.min(F.struct("_pos", "_name")).alias("m")).select("_f", "m._pos", "m._name"))
    good = {r[0] for r in of.select("_pos").distinct().collect()}  # at most one for each given path
    rows = rows.join(checked_broadcast(of), F.col("file") == F.col("_f"))
    seq = dense_index(rows, [F.col("_pos"), F.col("file"), F.col("_block"), F.col("_line")], idx_col="seq")
    out = seq.withColumn("file", F.col("_name")).drop("_f", "_pos", "_name", "_block", "_line")
    return out, [p for i, p in enumerate(paths) if i not in good]


def typed(wide: DataFrame) -> DataFrame:
    """X1 by column (Q1): code and paths stay text, the date is ``d.m.Y``,
    cost and gain are numbers."""
    return wide.select(
        cell_text(F.col("code")).alias("code"),
        cell_date(F.col("date")).alias("date"),
        cell_text(F.col("class_label")).alias("class_label"),
        cell_number(F.col("error_cost")).alias("error_cost"),
        cell_number(F.col("success_gain")).alias("success_gain"),
        *[c for c in wide.columns if c.startswith("path") or c in ("file", "line", "seq", "_block", "_line")],
    )


def unpivot(wide: DataFrame) -> DataFrame:
    """S3: every non-empty path cell becomes one announcement sharing the row's
    five fields; a row without any path yields nothing."""
    paths = [c for c in wide.columns if c.startswith("path")]
    keep = [c for c in wide.columns if c not in paths]
    cells = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(c).alias("p")) for i, c in enumerate(paths)])
    nonempty = F.filter(cells, lambda s: s.p.isNotNull() & (s.p != ""))
    return wide.select(*keep, F.explode(nonempty).alias("_c")).select(
        *keep, F.col("_c.slot").alias("slot"), F.col("_c.p").alias("path")
    )


def check_counts(wide: DataFrame, by: str = "file") -> DataFrame:
    """announcements per manifest file, nothing changed."""
    return unpivot(wide).groupBy(by).agg(F.count(F.lit(1)).alias("announcements"))


def write_manifest(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K10 sink: header + rows, ``;``-separated (one file per partition)."""
    out = rows.select(
        F.col("code").alias(HEADER[0]),
        F.col("date").alias(HEADER[1]),
        F.col("class_label").alias(HEADER[2]),
        F.col("error_cost").cast("string").alias(HEADER[3]),
        F.col("success_gain").cast("string").alias(HEADER[4]),
        F.col("path").alias(HEADER[5]),
    )
    out.write.mode(mode).option("sep", ";").option("header", True).csv(path)


def generate_demo(files: DataFrame, short_per_class: int = 100) -> DataFrame:
    """A demo manifest over document files ``(path)``: class ``neg``
    when the path contains ``neg`` else ``pos``; ordered by path inside each
    class, the first ``short_per_class`` get the symbol ``MOVIE_SHORT``, the
    rest ``MOVIE``; dates step two days per class from 1990-01-01 (neg) and
    1990-01-02 (pos) - the reference's counters are crossed; costs 1."""
    from wordtally.operators.ranking import dense_index

    lab = files.select("path", F.when(F.col("path").contains("neg"), "neg").otherwise("pos").alias("class_label"))
    ranked = dense_index(lab, [F.col("path").asc()], group="class_label", idx_col="rn")
    start = F.when(F.col("class_label") == "neg", F.lit("1990-01-01")).otherwise(F.lit("1990-01-02")).cast("date")
    return ranked.select(
        F.when(F.col("rn") < short_per_class, "MOVIE_SHORT").otherwise("MOVIE").alias("code"),
        F.date_format(F.date_add(start, (2 * (F.col("rn") + 1)).cast("int")), "dd.MM.yyyy").alias("date"),
        "class_label",
        F.lit("1").alias("error_cost"),
        F.lit("1").alias("success_gain"),
        "path",
    )


def announcement_rows(wide: DataFrame, root: str | None = None) -> DataFrame:
    """Typed, unpivoted manifest rows in the shape the registry imports:
    ``id, seq, symbol, associated_date, class_label, error_cost, success_gain,
    original_url``. ``seq`` is the dense position in (row, cell) order; a
    relative path is resolved against ``root``."""
    from wordtally.operators.ranking import dense_index

    rows = dense_index(unpivot(typed(wide)).withColumnRenamed("seq", "_row"), [F.col("_row"), F.col("slot")], idx_col="seq")
    path = F.col("path")
    if root:
        rel = ~(path.startswith("/") | path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"))
        path = F.when(rel, F.concat(F.lit(root.rstrip("/") + "/"), path)).otherwise(path)
    return rows.select(
        F.col("seq").alias("id"),
        "seq",
        F.col("code").alias("symbol"),
        F.col("date").alias("associated_date"),
        "class_label",
        "error_cost",
        "success_gain",
        path.alias("original_url"),
    )