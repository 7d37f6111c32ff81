"""HTML queries: X15, X16, K9."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordtally.functions import html as H
from wordtally.plans import query
from wordtally.sources.files import to_text
from wordtally.sources.tables import read_table

# The named entities decoded by the SQL twin (the JVM side
# decodes the whole HTML 4 table); &amp; must come last.
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "),
             ("&copy;", "©"), ("&middot;", "·"), ("&reg;", "®"), ("&mdash;", "—"),
             ("&ndash;", "–"), ("&hellip;", "…"), ("&rsquo;", "’"), ("&lsquo;", "‘"),
             ("&ldquo;", "“"), ("&rdquo;", "”"), ("&amp;", "&")]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_clean(h: str) -> str:
    s = f"regexp_replace(coalesce({h}, ''), '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g')"
    return f"regexp_replace({s}, '(?s)<!--.*?-->', '', 'g')"


def _sql_finish(frag: str) -> str:
    s = f"regexp_replace({frag}, '(?s)<[^>]*>', '', 'g')"
    for ent, ch in _ENTITIES:
        s = f"replace({s}, {_q(ent)}, {_q(ch)})"
    return f"replace({s}, chr(8217), '''')"


def _sql_text(h: str) -> str:
    return _sql_finish(_sql_clean(h))


def _sql_block(h: str, tag: str) -> str:
    return _sql_finish(f"regexp_extract({_sql_clean(h)}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)")


@query("html_text", f"SELECT page_id, {_sql_text('html')} AS text FROM pages")
def html_text(spark, sf_dir):
    """The text of every page (scripts and comments dropped)."""
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", H.html_to_text(F.col("html")).alias("text"))


@query("html_block", f"SELECT page_id, {_sql_block('html', 'article')} AS text FROM pages")
def html_block(spark, sf_dir):
    """X15 with the block selector ``article``."""
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", H.html_block(F.col("html"), "article").alias("text"))


@query(
    "bulk_text",
    f"""WITH f AS (
  SELECT url AS path, 'html' AS file_type, {_sql_text('html')} AS text FROM pages
  UNION ALL SELECT 'docs/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt', 'txt',
                   replace(replace(text, chr(700), ''''), chr(8217), '''') FROM documents)
SELECT path, file_type, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5, CAST(NULL AS VARCHAR) AS error FROM f""",
)
def bulk_text(spark, sf_dir):
    """Bulk conversion of pages (html) and documents (txt) to text,
    with the apostrophe fix; one row per file with its error (none here)."""
    pages = read_table(spark, sf_dir, "pages").select(
        F.col("url").alias("path"), F.lit("html").alias("file_type"), F.col("html").alias("raw")
    )
    docs = read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit("txt").alias("file_type"),
        F.col("text").alias("raw"),
    )
    t = to_text(pages.unionByName(docs))
    return t.select("path", "file_type", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), "error")
