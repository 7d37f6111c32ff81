"""Vector queries: M2 with J7, X13, X14, G3, G7, G8, F4."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordtally.operators.vectorize import fit_transformation
from wordtally.options import TransformOptions
from wordtally.plans import query
from wordtally.plans import sql as S
from wordtally.plans.q_dictionary import dictionary_ctes
from wordtally.sources.tables import labelled_selection


def _bag_sql(opts: TransformOptions, select: str) -> str:
    return S.with_ctes(*bag_ctes(opts)) + select


def bag_ctes(opts: TransformOptions) -> list[str]:
    """dictionary CTEs + bag (id, word, idx, tf), ncorp, cdf, idf."""
    toks = S.join_negations("words", opts.negation_word) if opts.neg else "words"
    return dictionary_ctes(opts) + [
        f"""bag AS (SELECT t.id, t.word, d.idx, count(*) AS tf
        FROM (SELECT id, unnest({toks}) AS word FROM sel) t JOIN dict d ON t.word = d.word
        GROUP BY t.id, t.word, d.idx)""",
        "ncorp AS (SELECT count(*) AS n FROM sel)",
        "cdf AS (SELECT idx, count(*) AS df FROM bag GROUP BY idx)",
        "idf AS (SELECT idx, ln((n + 1.0) / (df + 1.0)) + 1.0 AS idf FROM cdf, ncorp)",
    ]


def _fit(spark, sf_dir, opts):
    sel = labelled_selection(spark, sf_dir, opts.min_sent)
    return sel, fit_transformation(sel, opts)


def _rounded(df):
    return df.select("id", "idx", F.round("value", 6).alias("value"))


@query("bag", _bag_sql(TransformOptions(), "SELECT id, word, tf FROM bag"))
def bag(spark, sf_dir):
    """G3 + F4: term frequency of dictionary words per document."""
    sel, tm = _fit(spark, sf_dir, TransformOptions())
    return tm.bag(sel).select("id", "word", "tf")


@query(
    "term_counts",
    _bag_sql(TransformOptions(tfidf=False), "SELECT id, idx, round(CAST(tf AS DOUBLE), 6) AS value FROM bag"),
)
def term_counts(spark, sf_dir):
    """Counts by dictionary index (tf-idf off)."""
    opts = TransformOptions(tfidf=False)
    sel, tm = _fit(spark, sf_dir, opts)
    return _rounded(tm.long_form(sel))


@query(
    "tfidf",
    _bag_sql(TransformOptions(), "SELECT b.id, b.idx, round(b.tf * i.idf, 6) AS value FROM bag b JOIN idf i ON b.idx = i.idx"),
)
def tfidf(spark, sf_dir):
    """X13 + G7: tf * (ln((n+1)/(df+1)) + 1) with the corpus df of the selection."""
    sel, tm = _fit(spark, sf_dir, TransformOptions())
    return _rounded(tm.long_form(sel))


@query(
    "tfidf_l2",
    _bag_sql(
        TransformOptions(normalize=True),
        """SELECT id, idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value
FROM (SELECT b.id, b.idx, b.tf * i.idf AS v FROM bag b JOIN idf i ON b.idx = i.idx)""",
    ),
)
def tfidf_l2(spark, sf_dir):
    """Tf-idf rows scaled to unit L2 norm."""
    sel, tm = _fit(spark, sf_dir, TransformOptions(normalize=True))
    return _rounded(tm.long_form(sel))


@query("presence", _bag_sql(TransformOptions(boolean=True), "SELECT id, idx, 1.0::DOUBLE AS value FROM bag"))
def presence(spark, sf_dir):
    """1.0 where a dictionary word occurs (no tf-idf, no norm)."""
    sel, tm = _fit(spark, sf_dir, TransformOptions(boolean=True))
    return _rounded(tm.long_form(sel))
