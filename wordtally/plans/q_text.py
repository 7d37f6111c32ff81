"""Text queries: X3-X11, F5, G6."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordtally.functions import lemma as L
from wordtally.functions import text as T
from wordtally.plans import query
from wordtally.plans import sql as S
from wordtally.sources.tables import doc_texts

NEG_TRIGGER = "the"  # no "not" occurs in the driver documents (SURVEY 7.2)


@query(
    "sentence_split",
    S.with_ctes(S.ANN)
    + f"""SELECT id, CAST(unnest(range(len(s))) AS INTEGER) AS sentence_no, unnest(s) AS sentence
FROM (SELECT id, {S.sentences('text')} AS s FROM ann)""",
)
def sentence_split(spark, sf_dir):
    ann = doc_texts(spark, sf_dir)
    return ann.select("id", F.posexplode(T.sentences("text")).alias("sentence_no", "sentence"))


@query(
    "tokenize",
    S.with_ctes(S.ANN)
    + f"""SELECT id, sentence_no, CAST(unnest(range(len(w))) AS INTEGER) AS token_no, unnest(w) AS token
FROM (SELECT id, sentence_no, {S.words('sentence')} AS w
      FROM (SELECT id, CAST(unnest(range(len(s))) AS INTEGER) AS sentence_no, unnest(s) AS sentence
            FROM (SELECT id, {S.sentences('text')} AS s FROM ann)))""",
)
def tokenize(spark, sf_dir):
    ann = doc_texts(spark, sf_dir)
    sents = ann.select("id", F.posexplode(T.sentence_words("text")).alias("sentence_no", "w"))
    return sents.select("id", "sentence_no", F.posexplode("w").alias("token_no", "token"))


@query(
    "doc_stats",
    S.with_ctes(S.ANN)
    + f"""SELECT id, {S.sentence_count('text')} AS sentences, CAST(len({S.words('text')}) AS INTEGER) AS tokens
FROM ann""",
)
def doc_stats(spark, sf_dir):
    """Sentences (empty ones count) and kept tokens per document."""
    ann = doc_texts(spark, sf_dir)
    return ann.select("id", T.sentence_count("text").alias("sentences"), F.size(T.words("text")).alias("tokens"))


@query(
    "negation",
    S.with_ctes(S.ANN)
    + f"""SELECT id, CAST(unnest(range(len(w))) AS INTEGER) AS token_no, unnest(w) AS token
FROM (SELECT id, {S.join_negations(S.words('text'), NEG_TRIGGER)} AS w FROM ann)""",
)
def negation(spark, sf_dir):
    """X10 over whole documents with the trigger word ``the``."""
    ann = doc_texts(spark, sf_dir)
    return ann.select("id", F.posexplode(T.join_negations(T.words("text"), NEG_TRIGGER)).alias("token_no", "token"))


@query(
    "stopword_filter",
    S.with_ctes(S.ANN)
    + f"""SELECT id, CAST(unnest(range(len(w))) AS INTEGER) AS token_no, unnest(w) AS token
FROM (SELECT id, {S.remove_stopwords(S.words('text'), T.ENGLISH_STOPWORDS)} AS w FROM ann)""",
)
def stopword_filter(spark, sf_dir):
    ann = doc_texts(spark, sf_dir)
    return ann.select("id", F.posexplode(T.remove_stopwords(T.words("text"))).alias("token_no", "token"))


_RULES_SQL = ", ".join(f"({p}, {i}, {S.q(s)}, {S.q(r)})" for i, (p, s, r) in enumerate(L.DETACHMENT_RULES))


@query(
    "lemmatize",
    S.with_ctes(
        S.ANN,
        f"w AS (SELECT id, {S.words('text')} AS w FROM ann)",
        "toks AS (SELECT id, CAST(unnest(range(len(w))) AS INTEGER) AS token_no, unnest(w) AS token FROM w)",
        "vocab AS (SELECT DISTINCT token AS word FROM toks)",
        f"rules(pos_rank, rule_rank, suffix, repl) AS (VALUES {_RULES_SQL})",
        """cand AS (SELECT v.word AS form, r.pos_rank, r.rule_rank,
                  substring(v.word, 1, length(v.word) - length(r.suffix)) || r.repl AS lemma
           FROM vocab v JOIN rules r ON ends_with(v.word, r.suffix) AND length(v.word) > length(r.suffix))""",
        "known AS (SELECT * FROM cand WHERE lemma IN (SELECT word FROM vocab) AND length(lemma) < length(form))",
        """best AS (SELECT form, lemma FROM (SELECT *, row_number() OVER (
                  PARTITION BY form ORDER BY pos_rank, length(lemma), rule_rank) AS rn FROM known) WHERE rn = 1)""",
    )
    + "SELECT t.id, t.token_no, coalesce(b.lemma, t.token) AS lemma FROM toks t LEFT JOIN best b ON t.token = b.form",
)
def lemmatize(spark, sf_dir):
    """X8 with the lemma table derived from the corpus vocabulary."""
    from wordtally.session import reliable_checkpoint

    ann = doc_texts(spark, sf_dir)
    words = reliable_checkpoint(ann.select("id", T.words("text").alias("words")))  # tokenized once, read twice
    vocab = words.select(F.explode(F.array_distinct("words")).alias("word")).distinct()
    table = reliable_checkpoint(L.lemma_table(vocab))
    return L.apply_lemmas(words, table).select("id", F.posexplode("words").alias("token_no", "lemma"))
