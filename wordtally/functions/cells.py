"""Scalar rules for manifest cells and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# a number as Python's float() reads it (nan excluded: it stays text, Q1)
NUMBER = r"^[\t\n\x0B\f\r ]*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))[\t\n\x0B\f\r ]*$"
DATE = r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"

# Extension -> stored file type
FILE_TYPES = {"txt": "txt", "text": "txt", "htm": "html", "html": "html", "pdf": "pdf"}


def cell_kind(cell: Column) -> Column:
    """``date`` when ``d.m.Y`` parses, else ``number`` when float() would
    read it, else ``text``."""
    as_date = F.when(cell.rlike(DATE), F.try_to_date(cell, "d.M.yyyy"))
    return F.when(as_date.isNotNull(), "date").when(cell.rlike(NUMBER), "number").otherwise("text")


def cell_date(cell: Column) -> Column:
    return F.when(cell.rlike(DATE), F.try_to_date(cell, "d.M.yyyy"))


def cell_number(cell: Column) -> Column:
    return F.when(cell_date(cell).isNull() & cell.rlike(NUMBER), cell_text(cell).cast("double"))


def cell_text(cell: Column) -> Column:
    """The stripped string (X1's last case)."""
    return F.regexp_replace(cell, r"^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$", "")


def extension(path: Column) -> Column:
    """What follows the last dot of the stripped path, lower-cased."""
    return F.lower(F.regexp_extract(F.trim(path), r"^.+\.(.+)$", 1))


def file_type(path: Column) -> Column:
    """``txt``, ``html``, ``pdf`` or ``unknown`` by extension."""
    ext = extension(path)
    out = F.lit("unknown")
    for e, t in reversed(list(FILE_TYPES.items())):
        out = F.when(ext == e, F.lit(t)).otherwise(out)
    return out


def fix_apostrophes(text: Column) -> Column:
    """Modifier letter apostrophe and right single quote -> '."""
    return F.translate(text, "ʼ’", "''")
