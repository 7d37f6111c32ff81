"""HTML to text with native expressions.

Script text is dropped, comments and tags are stripped, entities decoded by
the JVM (HTML 4 table, numeric entities included), U+2019 becomes ``'``
(Q6). Style text stays, as in the reference. The block selector takes one
tag name and returns the text of its first element, or ``''`` when there is
none; nested elements of the same tag and general XPath are not supported.
Regex stripping is not a parser: a ``>`` inside an attribute value ends the
tag early.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
_COMMENT = r"(?s)<!--.*?-->"
_TAG = r"(?s)<[^>]*>"


def _clean(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), _SCRIPT, ""), _COMMENT, "")


def unescape(text: Column) -> Column:
    return F.call_function(
        "java_method", F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), text
    )


def _finish(fragment: Column) -> Column:
    return F.translate(unescape(F.regexp_replace(fragment, _TAG, "")), "’", "'")


def html_to_text(html: Column) -> Column:
    return _finish(_clean(html))


def html_block(html: Column, tag: str) -> Column:
    """Text of the first ``<tag>`` element, ``''`` when there is none."""
    t = re.escape(tag)
    return _finish(F.regexp_extract(_clean(html), rf"(?is)<{t}\b[^>]*>(.*?)</{t}\s*>", 1))


def html_block_by(html: Column, tag: Column) -> Column:
    """X15 with a per-row block selector (the stored ``xpath`` of a registry
    row, a tag name): the whole text when the selector is null or empty, the
    first element's text otherwise, ``''`` when there is none."""
    safe = F.regexp_replace(tag, r"[^A-Za-z0-9_-]", "")
    pattern = F.concat(F.lit("(?is)<"), safe, F.lit(r"\b[^>]*>(.*?)</"), safe, F.lit(r"\s*>"))
    block = _finish(F.call_function("regexp_extract", _clean(html), pattern, F.lit(1)))
    return F.when(F.coalesce(safe, F.lit("")) == "", html_to_text(html)).otherwise(block)