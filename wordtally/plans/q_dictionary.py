"""Dictionary queries: M1 with F5-F8, G4, G5, U1, W1-W3, X12, K5."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordtally.operators.dictionary import DictionaryBuilder
from wordtally.options import TransformOptions
from wordtally.plans import query
from wordtally.plans import sql as S
from wordtally.sources.tables import labelled_selection

CUT = 50
SAMPLE_RATIO = 0.5
SEED = "42"


def dictionary_sql(opts: TransformOptions, select: str | None = None) -> str:
    """DuckDB twin of DictionaryBuilder.fit; ``select`` is the final SELECT over
    the CTE ``dict`` (word, idx, pos_idf, neg_idf, pos_df, neg_df)."""
    return S.with_ctes(*dictionary_ctes(opts)) + (
        select or "SELECT word, idx, round(pos_idf, 6) AS pos_idf, round(neg_idf, 6) AS neg_idf, pos_df, neg_df FROM dict"
    )


def dictionary_ctes(opts: TransformOptions) -> list[str]:
    """CTEs ann, tok, sel, smp, dw, cnt, dfs, ranked[, cut], dict."""
    toks = "words"
    if opts.neg:
        toks = S.join_negations(toks, opts.negation_word)
    if opts.stop:
        from wordtally.functions.text import ENGLISH_STOPWORDS

        toks = S.remove_stopwords(toks, list(opts.stopwords or ENGLISH_STOPWORDS))
    toks = S.min_length(toks, opts.min_tlen)
    sample = "sel" if opts.ratio >= 1.0 else f"(SELECT * FROM sel WHERE {S.hash_fraction('id', opts.seed)} <= {opts.ratio})"
    cut = ""
    if opts.dict_cut > 0:
        k = opts.dict_cut
        cut = f""",
cut AS (SELECT word, CAST(CASE WHEN n > {2 * k + 1} AND idx >= {k} THEN idx - (n - {2 * k}) ELSE idx END AS INTEGER) AS idx,
               pos_idf, neg_idf, pos_df, neg_df
        FROM (SELECT *, count(*) OVER () AS n FROM ranked)
        WHERE n <= {2 * k + 1} OR idx < {k} OR idx >= n - {k})"""
    final = "cut" if cut else "ranked"
    return [
            S.ANN,
            S.TOK,
            S.SEL,
            f"smp AS (SELECT * FROM {sample})",
            f"dw AS (SELECT DISTINCT id, class_label, unnest({toks}) AS word FROM smp)",
            """cnt AS (SELECT count(*) FILTER (WHERE class_label = 'pos') AS n_pos,
                      count(*) FILTER (WHERE class_label <> 'pos') AS n_neg FROM smp)""",
            f"""dfs AS (SELECT word, count(*) FILTER (WHERE class_label = 'pos') AS pos_df,
                      count(*) FILTER (WHERE class_label <> 'pos') AS neg_df
               FROM dw GROUP BY word HAVING count(*) >= {opts.min_tokens})""",
            """ranked AS (SELECT word,
                  CAST(row_number() OVER (ORDER BY (neg_df + 1.0)::DOUBLE / (pos_df + 1.0) DESC, word) - 1 AS INTEGER) AS idx,
                  ln((n_pos + 1.0) / (pos_df + 1.0)) AS pos_idf, ln((n_neg + 1.0) / (neg_df + 1.0)) AS neg_idf,
                  pos_df, neg_df
               FROM dfs, cnt)"""
            + cut,
            f"dict AS (SELECT * FROM {final})",
    ]


def rounded(d):
    return d.select(
        "word", "idx", F.round("pos_idf", 6).alias("pos_idf"), F.round("neg_idf", 6).alias("neg_idf"), "pos_df", "neg_df"
    )


def fit(spark, sf_dir, opts: TransformOptions):
    return DictionaryBuilder(opts).fit(labelled_selection(spark, sf_dir, opts.min_sent))


@query("dictionary", dictionary_sql(TransformOptions()))
def dictionary(spark, sf_dir):
    """M1 with the reference's default options."""
    return rounded(fit(spark, sf_dir, TransformOptions()).dictionary)


@query("dictionary_cut", dictionary_sql(TransformOptions(dict_cut=CUT)))
def dictionary_cut(spark, sf_dir):
    """The first and last 50 words."""
    return rounded(fit(spark, sf_dir, TransformOptions(dict_cut=CUT)).dictionary)


_OPTS_FULL = TransformOptions(ratio=SAMPLE_RATIO, seed=SEED, neg=True, negation_word="the", stop=True, min_tlen=4, min_tokens=2)


@query("dictionary_options", dictionary_sql(_OPTS_FULL))
def dictionary_options(spark, sf_dir):
    """M1 with sampling, negations (trigger ``the``), stop words, length 4, threshold 2."""
    return rounded(fit(spark, sf_dir, _OPTS_FULL).dictionary)


@query(
    "dictionary_report",
    dictionary_sql(
        TransformOptions(),
        """SELECT idx, word, CASE WHEN pos_df < neg_df THEN 'neg' ELSE 'pos' END AS argument_for,
       pos_df AS pos_count, neg_df AS neg_count, round(pos_idf, 6) AS pos_idf, round(neg_idf, 6) AS neg_idf FROM dict""",
    ),
)
def dictionary_report(spark, sf_dir):
    """K5 rows (F10 argument for)."""
    rep = fit(spark, sf_dir, TransformOptions()).report()
    return rep.withColumn("pos_idf", F.round("pos_idf", 6)).withColumn("neg_idf", F.round("neg_idf", 6))


@query(
    "dictionary_report_facts",
    dictionary_sql(
        TransformOptions(),
        "SELECT (SELECT count(*) FROM dict) AS dictionary_length, (SELECT n_pos + n_neg FROM cnt) AS documents_processed",
    ),
)
def dictionary_report_facts(spark, sf_dir):
    """K5 header facts: dictionary length and documents processed."""
    return fit(spark, sf_dir, TransformOptions()).report_facts()


@query(
    "class_vocab_union",
    S.with_ctes(S.ANN, S.TOK, S.SEL)
    + f"""SELECT word FROM (SELECT DISTINCT unnest({S.min_length('words', 3)}) AS word FROM sel WHERE class_label = 'pos')
UNION SELECT word FROM (SELECT DISTINCT unnest({S.min_length('words', 3)}) AS word FROM sel WHERE class_label = 'neg')""",
)
def class_vocab_union(spark, sf_dir):
    """Distinct union of pos words and neg words (before the threshold),
    as one aggregation over per-document distinct words."""
    b = DictionaryBuilder(TransformOptions())
    dfs = b.document_frequencies(labelled_selection(spark, sf_dir))
    return dfs.where(F.col("word").isNotNull()).select("word")


@query(
    "doc_sample",
    S.with_ctes(S.ANN, S.TOK, S.SEL)
    + f"SELECT id, class_label FROM sel WHERE {S.hash_fraction('id', SEED)} <= {SAMPLE_RATIO}",
)
def doc_sample(spark, sf_dir):
    """F8: the repeatable half sample that builds the dictionary."""
    b = DictionaryBuilder(TransformOptions(ratio=SAMPLE_RATIO, seed=SEED))
    return b.sample(labelled_selection(spark, sf_dir)).select("id", "class_label")


def _lemma_dictionary_sql() -> str:
    from wordtally.functions.lemma import DETACHMENT_RULES

    rules = ", ".join(f"({p_}, {i}, {S.q(sf)}, {S.q(r)})" for i, (p_, sf, r) in enumerate(DETACHMENT_RULES))
    ctes = dictionary_ctes(TransformOptions())
    k = next(i for i, c in enumerate(ctes) if c.startswith("sel AS ("))
    lemma_ctes = [
        ctes[k].replace("sel AS (", "sel0 AS (", 1),
        "vocab AS (SELECT DISTINCT unnest(words) AS word FROM sel0)",
        f"rules(pos_rank, rule_rank, suffix, repl) AS (VALUES {rules})",
        """cand AS (SELECT v.word AS form, r.pos_rank, r.rule_rank,
                  substring(v.word, 1, length(v.word) - length(r.suffix)) || r.repl AS lemma
           FROM vocab v JOIN rules r ON ends_with(v.word, r.suffix) AND length(v.word) > length(r.suffix))""",
        "known AS (SELECT * FROM cand WHERE lemma IN (SELECT word FROM vocab) AND length(lemma) < length(form))",
        """best AS (SELECT form, lemma FROM (SELECT *, row_number() OVER (
                  PARTITION BY form ORDER BY pos_rank, length(lemma), rule_rank) AS rn FROM known) WHERE rn = 1)""",
        "lm AS (SELECT map(coalesce(list(form), []), coalesce(list(lemma), [])) AS m FROM best)",
        "sel AS (SELECT sel0.* REPLACE (list_transform(words, lambda x: coalesce(lm.m[x], x)) AS words) FROM sel0, lm)",
    ]
    ctes = ctes[:k] + lemma_ctes + ctes[k + 1:]
    return S.with_ctes(*ctes) + (
        "SELECT word, idx, round(pos_idf, 6) AS pos_idf, round(neg_idf, 6) AS neg_idf, pos_df, neg_df FROM dict"
    )


@query("dictionary_lemmas", _lemma_dictionary_sql())
def dictionary_lemmas(spark, sf_dir):
    """X8 in the token filter: the dictionary over lemmatized tokens, the lemma
    table derived from the selection's own vocabulary."""
    from wordtally.functions.lemma import apply_lemmas, lemma_table
    from wordtally.session import reliable_checkpoint

    sel = labelled_selection(spark, sf_dir)
    vocab = sel.select(F.explode(F.array_distinct("words")).alias("word")).distinct()
    table = reliable_checkpoint(lemma_table(vocab))
    lemmatized = apply_lemmas(sel, table)
    return rounded(DictionaryBuilder(TransformOptions()).fit(lemmatized).dictionary)