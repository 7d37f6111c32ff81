"""M2: documents -> feature values with a fitted dictionary.

Two physical forms of the same values:

* long form ``(id, idx, value)`` - relational: explode the words, join the
  dictionary (broadcast after a row-count check), count per (id, idx) with
  map-side partial aggregation (a document's tokens sit in one partition, so
  the shuffle carries the bag, not the tokens), corpus document frequency per
  index (G7), tf-idf (X13) or presence (X14), L2 norm per document (G8).
* vector form ``(id, features)`` for the pyspark.ml learners: the long form
  gathered per document and written as the stored form of MLlib's vectors, so
  neither the vocabulary nor the values pass the driver or Python. Reduced
  rows (M3) are dense vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordtally.operators import reduction as R
from wordtally.operators.dictionary import DictionaryBuilder, DictionaryModel, prepared_tokens
from wordtally.operators.joins import broadcast_limit, checked_broadcast
from wordtally.options import TransformOptions
from wordtally.session import drop_checkpoints, reliable_checkpoint


@dataclass
class Counted:
    """Documents whose words are counted already (merged rows): ``rows`` with an ``id`` each, ``bag(id, word, tf)``
    with negations joined. Stands wherever documents with a token list ``words`` do."""

    rows: DataFrame
    bag: DataFrame


def rows_of(docs: DataFrame | Counted) -> DataFrame:
    return docs.rows if isinstance(docs, Counted) else docs


@dataclass
class TransformationModel:
    """The fitted transformation: dictionary + corpus idf + options."""

    dictmodel: DictionaryModel
    idf: DataFrame | None  # idx, idf (= ln((n+1)/(df+1)) + 1), present when tf-idf is on
    n_corpus: int  # documents in the selection the transformation was fitted on
    options: TransformOptions
    # the fitting selection and its materialised bag, reused when that same
    # selection is vectorized (a second pass over its tokens saved)
    fit_docs: DataFrame | None = None
    fit_bag: DataFrame | None = None
    reduction: R.Reduction | None = None  # the fitted axes when the reduction option is on

    @property
    def size(self) -> int:
        return self.dictmodel.size

    @property
    def n_features(self) -> int:
        """Columns of the samples: dictionary words, or components after a reduction."""
        return self.reduction.components if self.reduction else self.size

    def cut(self, k: int) -> "TransformationModel":
        """W2 as a post-step: the same transformation with the first k and last
        k dictionary words, re-indexed 0..2k-1. Document frequencies, class
        idfs and corpus idfs do not depend on the cut, so nothing is rescanned.
        Only valid on an uncut transformation."""
        if self.options.dict_cut:
            raise ValueError("the transformation is already cut")
        if self.reduction:
            raise ValueError("a reduced transformation is fitted to its whole dictionary")
        n = self.size
        if k <= 0 or n <= 2 * k + 1:
            return TransformationModel(self.dictmodel, self.idf, self.n_corpus, self.options.replace(dict_cut=k))

        def keep(df: DataFrame) -> DataFrame:
            return df.where((F.col("idx") < k) | (F.col("idx") >= n - k)).withColumn(
                "idx", F.when(F.col("idx") < k, F.col("idx")).otherwise(F.col("idx") - (n - 2 * k)).cast("int")
            )

        dm = self.dictmodel
        cut_dm = DictionaryModel(reliable_checkpoint(keep(dm.dictionary)), 2 * k, dm.n_pos, dm.n_neg,
                                 dm.options.replace(dict_cut=k), dm.sample_ids)
        out = TransformationModel(cut_dm, keep(self.idf) if self.idf is not None else None, self.n_corpus,
                                  self.options.replace(dict_cut=k))
        if self.fit_bag is not None:
            out.fit_bag = keep(self.fit_bag)
            out.fit_docs = self.fit_docs
        return out

    def bag(self, docs: DataFrame | Counted) -> DataFrame:
        """G3 restricted to dictionary words (F4): ``id, word, idx, tf``.

        With a broadcastable dictionary the join runs map-side before the
        count, so words outside it never reach the shuffle. Otherwise the
        tokens are first counted per (document, word) - map-side partial
        aggregation, one row per word a document holds - and only that bag is
        shuffle-joined to the dictionary (AQE splits hot words)."""
        if self.fit_bag is not None and rows_of(docs) is self.fit_docs:
            return self.fit_bag
        if isinstance(docs, Counted):
            d = checked_broadcast(self.dictmodel.dictionary.select("word", "idx"), self.size)
            return docs.bag.join(d, "word").select("id", "word", "idx", "tf")
        toks = prepared_tokens(F.col("words"), self.options, for_dictionary=False)
        exploded = docs.select("id", F.explode(toks).alias("word"))
        d = self.dictmodel.dictionary.select("word", "idx")
        if self.dictmodel.size <= broadcast_limit(d):
            joined = exploded.join(F.broadcast(d), "word")
            return joined.groupBy("id", "word", "idx").agg(F.count(F.lit(1)).alias("tf"))
        counted = exploded.groupBy("id", "word").agg(F.count(F.lit(1)).alias("tf"))
        return counted.join(d, "word").select("id", "word", "idx", "tf")

    def corpus_idf(self) -> DataFrame:
        """``idx, idf`` over the materialised bag of the fitting selection."""
        dfs = self.fit_bag.groupBy("idx").agg(F.count(F.lit(1)).alias("df"))
        return reliable_checkpoint(dfs.select("idx", (F.log((F.lit(self.n_corpus) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")))

    def term_counts(self, docs: DataFrame | Counted) -> DataFrame:
        """Count matrix in long form ``id, idx, value``."""
        return self.bag(docs).select("id", "idx", F.col("tf").cast("double").alias("value"))

    def long_form(self, docs: DataFrame | Counted) -> DataFrame:
        """Feature values ``id, idx, value`` as the options say."""
        o = self.options
        bag = self.bag(docs)
        if o.boolean:
            return bag.select("id", "idx", F.lit(1.0).alias("value"))
        vals = bag.select("id", "idx", F.col("tf").cast("double").alias("value"))
        if o.tfidf and self.idf is not None:
            vals = vals.join(checked_broadcast(self.idf, self.size), "idx").select(
                "id", "idx", (F.col("value") * F.col("idf")).alias("value")
            )
        if o.normalize:
            norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("id")))
            vals = vals.select("id", "idx", (F.col("value") / norm).alias("value"))
        return vals

    def features(self, docs: DataFrame | Counted) -> DataFrame:
        """Samples in long form ``id, idx, value``: the values, reduced when the option is on."""
        if not self.reduction:
            return self.long_form(docs)
        return self.reduced(docs).select("id", F.posexplode("reduced").alias("idx", "value"))

    def reduced(self, docs: DataFrame | Counted) -> DataFrame:
        """M3 applied: ``id, reduced array<double>``."""
        return R.project(self.reduction, self.long_form(docs), rows_of(docs).select("id"))

    def vectors(self, docs: DataFrame | Counted, out_col: str = "features") -> DataFrame:
        """Vector form for pyspark.ml: ``id`` and one vector a document, an empty one without dictionary words."""
        if self.reduction:
            from pyspark.ml.functions import array_to_vector

            return self.reduced(docs).select("id", array_to_vector("reduced").alias(out_col))
        return assemble(self.long_form(docs), self.size, rows_of(docs).select("id"), out_col)


def assemble(long: DataFrame, size: int, ids: DataFrame, out_col: str = "features") -> DataFrame:
    """Long form -> sparse vectors of every document in ``ids``.

    The columns of MLlib's stored sparse vector are written as Parquet and read
    back as vectors, without a Python function for each row."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import LongType, StructField, StructType

    rows = ids.select("id").join(R.sparse_rows(long), "id", "left")
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(size).alias("size"),
        F.coalesce("ix", F.array().cast("array<int>")).alias("indices"),
        F.coalesce("vx", F.array().cast("array<double>")).alias("values"),
    )
    schema = StructType([StructField("id", LongType()), StructField(out_col, VectorUDT())])
    return reliable_checkpoint(rows.select(F.col("id").cast("long").alias("id"), vector.alias(out_col)), schema)


def fit_transformation(selection: DataFrame, options: TransformOptions | None = None) -> TransformationModel:
    """M1 + the corpus idf over the whole selection (G7, not only the sample)."""
    o = options or TransformOptions()
    dm = DictionaryBuilder(o).fit(selection)
    # with the whole selection as sample, the class counts already add up to it
    n_corpus = dm.n_docs if o.ratio >= 1.0 else selection.count()
    tm = TransformationModel(dm, None, n_corpus, o)
    if o.tfidf and not o.boolean:
        tm.fit_bag = reliable_checkpoint(tm.bag(selection))
        tm.fit_docs = selection
        tm.idf = tm.corpus_idf()
    return reduce_features(tm, selection)


def reduce_features(tm: TransformationModel, docs: DataFrame | Counted) -> TransformationModel:
    """M3 as the last step of the fit: axes over the values of the whole selection."""
    if tm.options.reduction:
        values = reliable_checkpoint(tm.long_form(docs))
        tm.reduction = R.fit(values, rows_of(docs).select("id"), tm.size, tm.options.components)
        drop_checkpoints(values)
    return tm


def save_transformation(tm: TransformationModel, path: str, replace: bool = False) -> None:
    """K2: dictionary, corpus idf, axes of the reduction, sample ids and options as Parquet/JSON under ``path``."""
    import json
    import os

    mode = "overwrite" if replace else "errorifexists"
    dm = tm.dictmodel
    dm.dictionary.write.mode(mode).parquet(os.path.join(path, "dictionary"))
    if tm.idf is not None:
        tm.idf.write.mode(mode).parquet(os.path.join(path, "idf"))
    dm.sample_ids.write.mode(mode).parquet(os.path.join(path, "sample_ids"))
    if tm.reduction is not None:
        tm.reduction.axes.write.mode(mode).parquet(os.path.join(path, "axes"))
    meta = {"size": dm.size, "components": tm.reduction and tm.reduction.components, "n_pos": dm.n_pos, "n_neg": dm.n_neg, "n_corpus": tm.n_corpus,
            "options": {k: (list(v) if isinstance(v, tuple) else v) for k, v in vars(tm.options).items()}}
    spark = dm.dictionary.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(mode).text(os.path.join(path, "meta"))


def load_transformation(spark, path: str) -> TransformationModel:
    """A saved transformation, to vectorize another document set with it."""
    import json
    import os

    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
    opts = meta["options"]
    if opts.get("stopwords") is not None:
        opts["stopwords"] = tuple(opts["stopwords"])
    o = TransformOptions(**opts)
    dm = DictionaryModel(spark.read.parquet(os.path.join(path, "dictionary")), meta["size"], meta["n_pos"], meta["n_neg"], o,
                         spark.read.parquet(os.path.join(path, "sample_ids")))
    idf = spark.read.parquet(os.path.join(path, "idf")) if o.tfidf and not o.boolean else None
    axes = R.Reduction(spark.read.parquet(os.path.join(path, "axes")), meta["components"], meta["size"]) if o.reduction else None
    return TransformationModel(dm, idf, meta["n_corpus"], o, reduction=axes)
