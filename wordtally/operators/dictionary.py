"""M1: the per-class word dictionary (transformation fit).

sample (F8) -> negation (X10) -> stop words (F5) and minimum length (F6) ->
distinct words per document -> document frequency per class (G4) and class
document counts (G5) in ONE aggregation -> rare-word threshold (F7) -> class
idf (X12) -> order (W1) -> dense index (W3) -> two-ended cut (W2).

The aggregation is keyed by word with map-side partial aggregation, so a word
present in every document (a hot key) sends one partial row per map task. The
class counts ride along as the row of the null word, which saves a second
corpus scan. The result is written to the checkpoint folder: it is small next
to the corpus and read by the report, the vectorizer and the predictor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtally.functions import text as T
from wordtally.functions.hashing import in_sample
from wordtally.operators.joins import checked_broadcast
from wordtally.operators.ranking import dense_index
from wordtally.options import TransformOptions
from wordtally.session import reliable_checkpoint

DICT_COLUMNS = ["word", "idx", "pos_idf", "neg_idf", "pos_df", "neg_df"]


def prepared_tokens(words: Column, opts: TransformOptions, for_dictionary: bool = True) -> Column:
    """Token list as the dictionary sees it: negations joined when the option
    is on, then (dictionary only) stop words and the minimum length."""
    toks = T.join_negations(words, opts.negation_word) if opts.neg else words
    if for_dictionary:
        if opts.stop:
            toks = T.remove_stopwords(toks, list(opts.stopwords) if opts.stopwords is not None else None)
        toks = T.min_length(toks, opts.min_tlen)
    return toks


def class_idf(n_docs: Column, df: Column) -> Column:
    """ln((n + 1) / (df + 1))."""
    return F.log((n_docs + 1.0) / (df + 1.0))


def argument_for(pos_df: Column, neg_df: Column) -> Column:
    """neg when pos df < neg df, else pos."""
    return F.when(pos_df < neg_df, "neg").otherwise("pos")


@dataclass
class DictionaryModel:
    dictionary: DataFrame  # word, idx, pos_idf, neg_idf, pos_df, neg_df
    size: int
    n_pos: int
    n_neg: int
    options: TransformOptions
    sample_ids: DataFrame  # id of every document that built the dictionary

    @property
    def n_docs(self) -> int:
        return self.n_pos + self.n_neg

    def report(self) -> DataFrame:
        """K5 rows: word, argument for, counts and idfs in dictionary order."""
        d = self.dictionary
        return d.select(
            "idx",
            "word",
            argument_for(F.col("pos_df"), F.col("neg_df")).alias("argument_for"),
            F.col("pos_df").alias("pos_count"),
            F.col("neg_df").alias("neg_count"),
            "pos_idf",
            "neg_idf",
        )

    def report_facts(self) -> DataFrame:
        spark = self.dictionary.sparkSession
        return spark.createDataFrame(
            [(self.size, self.n_docs)], "dictionary_length long, documents_processed long"
        )


class DictionaryBuilder:
    """Estimator: ``fit(selection) -> DictionaryModel``.

    ``selection`` needs ``id``, ``class_label`` and a flat token list ``words``.
    """

    def __init__(self, options: TransformOptions | None = None):
        self.options = options or TransformOptions()

    def sample(self, selection: DataFrame) -> DataFrame:
        o = self.options
        if o.ratio >= 1.0:
            return selection
        return selection.where(in_sample(F.col("id"), o.ratio, o.seed))

    def document_frequencies(self, sample: DataFrame) -> DataFrame:
        """word, pos_df, neg_df over distinct words per document; the null word
        carries the class document counts."""
        per_doc = sample.select(
            F.when(F.col("class_label") == "pos", 1).otherwise(0).alias("_pos"),
            F.array_distinct(prepared_tokens(F.col("words"), self.options)).alias("_w"),
        )
        exploded = per_doc.select(
            "_pos", F.explode(F.concat(F.col("_w"), F.array(F.lit(None).cast("string")))).alias("word")
        )
        return exploded.groupBy("word").agg(
            F.sum("_pos").cast("long").alias("pos_df"), F.sum(1 - F.col("_pos")).cast("long").alias("neg_df")
        )

    def fit(self, selection: DataFrame) -> DictionaryModel:
        sample = self.sample(selection)
        return self._from_frequencies(self.document_frequencies(sample), sample.select("id"))

    def fit_bag(self, rows: DataFrame, bag: DataFrame) -> DictionaryModel:
        """Fit on documents whose words are counted already: ``rows`` has ``id``
        and ``class_label``, ``bag`` one row per (``id``, ``word``), negations joined."""
        o = self.options
        sample = self.sample(rows).select("id", F.when(F.col("class_label") == "pos", 1).otherwise(0).alias("_pos"))
        own = F.array("word")
        if o.stop:
            own = T.remove_stopwords(own, list(o.stopwords) if o.stopwords is not None else None)
        words = bag.where(F.size(T.min_length(own, o.min_tlen)) > 0).join(checked_broadcast(sample), "id").select("_pos", "word")
        counted = words.unionByName(sample.select("_pos", F.lit(None).cast("string").alias("word")))
        dfs = counted.groupBy("word").agg(
            F.sum("_pos").cast("long").alias("pos_df"), F.sum(1 - F.col("_pos")).cast("long").alias("neg_df")
        )
        return self._from_frequencies(dfs, sample.select("id"))

    def _from_frequencies(self, frequencies: DataFrame, sample_ids: DataFrame) -> DictionaryModel:
        o = self.options
        dfs = reliable_checkpoint(frequencies)
        counts = dfs.where(F.col("word").isNull()).select("pos_df", "neg_df").first()
        n_pos, n_neg = (int(counts[0]), int(counts[1])) if counts else (0, 0)

        words = dfs.where(F.col("word").isNotNull() & ((F.col("pos_df") + F.col("neg_df")) >= o.min_tokens))
        size = words.count()  # read from the materialised frequencies
        words = words.select(
            "word",
            class_idf(F.lit(n_pos), F.col("pos_df")).alias("pos_idf"),
            class_idf(F.lit(n_neg), F.col("neg_df")).alias("neg_idf"),
            "pos_df",
            "neg_df",
            # Pos idf - neg idf descending is this ratio descending (an
            # exact IEEE quotient, so ties are ties in every engine); word breaks ties
            ((F.col("neg_df") + 1.0) / (F.col("pos_df") + 1.0)).alias("_order"),
        )
        ranked = dense_index(words, [F.col("_order").desc(), F.col("word").asc()], idx_col="idx").drop("_order")
        k = o.dict_cut
        if k > 0 and size > 2 * k + 1:
            # The first k and the last k words, re-indexed 0..2k-1
            ranked = ranked.where((F.col("idx") < k) | (F.col("idx") >= size - k)).withColumn(
                "idx", F.when(F.col("idx") < k, F.col("idx")).otherwise(F.col("idx") - (size - 2 * k))
            )
            size = 2 * k
        dictionary = reliable_checkpoint(ranked.withColumn("idx", F.col("idx").cast("int")).select(*DICT_COLUMNS))
        return DictionaryModel(
            dictionary=dictionary,
            size=size,
            n_pos=n_pos,
            n_neg=n_neg,
            options=o,
            sample_ids=sample_ids,
        )
