"""DuckDB SQL fragments that state the same rules as the Spark expressions.

They exist only for the oracle check: each registered query has an ANSI SQL
twin that DuckDB runs on the same parquet tables. RE2 has no look-around, so
the word rule is written as split-then-filter here and as a single
look-around extraction in Spark; both keep the maximal non-separator runs that
are whole word tokens.
"""

from __future__ import annotations

WS = r"\t\n\x0B\f\r "
SEP = r'[\t\n\x0B\f\r ,;:!?()\[\]{}<>"#$%&@*.]'


def q(s: str) -> str:
    """Quote a Python string as a SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(t: str) -> str:
    return f"regexp_replace(coalesce({t}, ''), '^[{WS}]+|[{WS}]+$', '', 'g')"


def sentence_count(t: str) -> str:
    s = strip(t)
    return f"CAST(CASE WHEN {s} = '' THEN 0 ELSE len(regexp_extract_all({s}, '[.!?][{WS}]+')) + 1 END AS INTEGER)"


def sentences(t: str) -> str:
    s = strip(t)
    return (
        f"CASE WHEN {s} = '' THEN CAST([] AS VARCHAR[]) ELSE "
        f"string_split(regexp_replace({s}, '([.!?])[{WS}]+', '\\1' || chr(57344), 'g'), chr(57344)) END"
    )


def words(t: str) -> str:
    raw = f"regexp_split_to_array(regexp_replace(coalesce({t}, ''), '--', ' ', 'g'), '{SEP}+')"
    clitic = (
        f"flatten(list_transform({raw}, lambda x: CASE "
        f"WHEN regexp_full_match(x, '(?i).+n''t') THEN [x[1:-4], 'n''t'] "
        f"WHEN regexp_full_match(x, '(?i).+''(?:s|m|d|ll|re|ve)') "
        f"THEN [regexp_extract(x, '(?i)^(.+)''(?:s|m|d|ll|re|ve)$', 1)] "
        f"ELSE [x] END))"
    )
    kept = f"list_filter({clitic}, lambda x: regexp_full_match(x, '[A-Za-z_]+-?[A-Za-z_]+') OR lower(x) = 'n''t')"
    return f"list_transform({kept}, lambda x: CASE WHEN lower(x) = 'n''t' THEN 'not' ELSE lower(x) END)"


def join_negations(w: str, trigger: str = "not") -> str:
    marked = f"regexp_replace(array_to_string({w}, ' '), '(^| ){trigger} ([^ ]+)', '\\1{trigger}' || chr(1) || '\\2', 'g')"
    return f"CASE WHEN len({w}) = 0 THEN {w} ELSE list_transform(string_split({marked}, ' '), lambda x: replace(x, chr(1), ' ')) END"


def min_length(w: str, n: int) -> str:
    return f"list_filter({w}, lambda x: length(x) >= {n})"


def remove_stopwords(w: str, stop: list[str]) -> str:
    lst = "[" + ", ".join(q(s) for s in stop) + "]"
    return f"list_filter({w}, lambda x: NOT list_contains({lst}, x))"


def hash_fraction(id_expr: str, seed: str) -> str:
    return f"(('0x' || substr(md5(CAST({id_expr} AS VARCHAR) || {q(seed)}), 1, 6))::BIGINT / 16777216.0)"


def random_vote(id_expr: str, seed: str) -> str:
    d = f"(('0x' || substr(md5(CAST({id_expr} AS VARCHAR) || {q('rnd' + seed)}), 1, 1))::INTEGER)"
    return f"CAST((({d}) % 2) * 2 - 1 AS INTEGER)"


ANN = f"""ann AS (
  SELECT d.doc_id AS id, d.source AS symbol,
         CAST(DATE '2010-01-01' + CAST(d.doc_id % 90 AS INTEGER) AS DATE) AS associated_date,
         CASE WHEN l.quality = 1 THEN 'pos' WHEN l.quality = 0 THEN 'neg' ELSE 'none' END AS class_label,
         CAST(1 + coalesce(l.toxic, 0) AS DOUBLE) AS error_cost,
         CAST(d.n_chars AS DOUBLE) / 1000.0 AS success_gain,
         d.text, md5(coalesce(d.text, '')) AS orig_md5, d.doc_id AS seq
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

TOK = f"""tok AS (
  SELECT id, symbol, class_label, error_cost, success_gain, associated_date,
         {sentence_count('text')} AS sentences, {words('text')} AS words
  FROM ann)"""

SEL = """sel AS (SELECT * FROM tok WHERE class_label IN ('pos', 'neg') AND sentences >= 1)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
