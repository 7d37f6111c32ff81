"""Queries over merged rows: the registry's documents, one row per (symbol, date), through the transformation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordtally.functions import text as T
from wordtally.operators import evaluate as E
from wordtally.operators import learners as LR
from wordtally.operators import registry as R
from wordtally.operators.merged import fit_merged, merged_selection
from wordtally.options import TransformOptions
from wordtally.plans import q_registry as Q
from wordtally.plans import query
from wordtally.plans import sql as S
from wordtally.plans.q_dictionary import rounded
from wordtally.plans.q_evaluate import CV_OPTS, _cv_ctes
from wordtally.plans.q_vectorize import bag_ctes
from wordtally.session import reliable_checkpoint
from wordtally.sources.tables import doc_texts

OPTS = TransformOptions()
IN_SYMBOLS = ", ".join(S.q(s) for s in Q.SYMBOLS)


def _merged_ctes(opts: TransformOptions) -> list[str]:
    """The CTEs of the bag over merged rows instead of documents."""
    parts = f"""rt AS (SELECT r.id, r.seq, r.symbol, r.associated_date, r.class_label, r.error_cost, r.success_gain,
              {S.sentence_count('a.text')} AS sentences, {S.words('a.text')} AS words, CAST(len({S.words('a.text')}) AS INTEGER) AS tokens
           FROM reg r JOIN ann a ON a.id = r.id)"""
    sel = """sel AS (SELECT m.tokenization_id AS id, any_value(m.class_label) AS class_label, any_value(m.error_cost) AS error_cost,
              any_value(m.success_gain) AS success_gain, flatten(list(r.words ORDER BY r.seq DESC)) AS words
           FROM mg m JOIN rt r ON m.symbol IS NOT DISTINCT FROM r.symbol AND m.associated_date = r.associated_date
           WHERE m.class_label IN ('pos', 'neg') AND m.sentences >= 1 GROUP BY m.tokenization_id)"""
    rest = [c for c in bag_ctes(opts) if c not in (S.ANN, S.TOK, S.SEL)]
    return [*Q._REG_TOK_SQL[:3], parts, f"mg AS ({Q._merge_sql('rt')})", sel, *rest]


def _fit(spark, sf_dir, opts=OPTS):
    _, reg, _ = Q._registry(spark, sf_dir, False)
    text = F.col("text")
    words = doc_texts(spark, sf_dir).select("id", T.sentence_count(text).alias("sentences"), T.words(text).alias("words"))
    tok = reg.join(words.withColumn("tokens", F.size("words")), "id").select(
        "id", "seq", "symbol", "associated_date", "class_label", "error_cost", "success_gain", "sentences", "tokens", "words"
    )
    sel = merged_selection(tok, opts)
    return sel, fit_merged(sel, opts)


@query(
    "merged_dictionary",
    S.with_ctes(*_merged_ctes(OPTS)) + "SELECT word, idx, round(pos_idf, 6) AS pos_idf, round(neg_idf, 6) AS neg_idf, pos_df, neg_df FROM dict",
)
def merged_dictionary(spark, sf_dir):
    """M1 over the merged table: a word counts once per (symbol, date)."""
    return rounded(_fit(spark, sf_dir)[1].dictmodel.dictionary)


@query(
    "merged_tfidf",
    S.with_ctes(*_merged_ctes(OPTS)) + "SELECT b.id, b.idx, round(b.tf * i.idf, 6) AS value FROM bag b JOIN idf i ON b.idx = i.idx",
)
def merged_tfidf(spark, sf_dir):
    """M2 over the merged table: term counts summed over the parts."""
    sel, tm = _fit(spark, sf_dir)
    return tm.long_form(sel).select("id", "idx", F.round("value", 6).alias("value"))


NEG = TransformOptions(neg=True, negation_word="the")


@query("merged_negation", S.with_ctes(*_merged_ctes(NEG)) + "SELECT id, word, idx, tf FROM bag")
def merged_negation(spark, sf_dir):
    """X10 over merged rows: a trigger at the end of a part joins the first word of the next one."""
    sel, tm = _fit(spark, sf_dir, NEG)
    return tm.bag(sel).select("id", "word", "idx", "tf")


@query(
    "merged_votes",
    S.with_ctes(*_cv_ctes(_merged_ctes(CV_OPTS)))
    + """SELECT id, fold, 'naive_bayes' AS learner, CAST(vote AS INTEGER) AS vote, CAST(y AS INTEGER) AS y FROM nb_votes
UNION ALL SELECT id, fold, 'knn', CAST(vote AS INTEGER), CAST(y AS INTEGER) FROM knn_votes""",
)
def merged_votes(spark, sf_dir):
    """M12 over the merged table: samples, folds and votes of its rows."""
    sel, tm = _fit(spark, sf_dir, CV_OPTS)
    feats = reliable_checkpoint(tm.features(sel))
    folds = reliable_checkpoint(E.assign_folds(E.training_set(sel.rows.select("id"), sel.rows, tm.dictmodel.sample_ids)))
    nb = LR.naive_bayes_votes(LR.naive_bayes_scores(feats.where("value > 0").select("id", "idx"), folds, tm.size))
    return nb.unionByName(LR.knn_votes(LR.knn_neighbours(feats, folds)))


_OLD = f"old AS ({Q._merge_sql(f'(SELECT * FROM rt WHERE associated_date < DATE {S.q(Q.SPLIT)})')})"


@query(
    "retokenize_registry",
    S.with_ctes(*Q._REG_TOK_SQL, _OLD)
    + f"""SELECT r.id, r.symbol, r.associated_date, CASE WHEN r.symbol IN ({IN_SYMBOLS}) THEN NULL ELSE o.tokenization_id END AS tokenization_id
FROM reg r LEFT JOIN old o ON o.symbol = r.symbol AND o.associated_date = r.associated_date""",
)
def retokenize_registry(spark, sf_dir):
    """Registry keys after the tokenizations of the symbol list are dropped."""
    reg = Q._stored_registry(spark, sf_dir)
    old = R.merge_tokenized(Q._reg_tokenized(reg, spark, sf_dir).where(F.col("associated_date") < F.lit(Q.SPLIT).cast("date")))
    keyed = reg.join(old.select("tokenization_id", *R.merge_key()), R.merge_key(), "left")
    _, after = R.drop_tokenizations(keyed, old, Q.SYMBOLS)
    return after.select("id", "symbol", "associated_date", "tokenization_id")
