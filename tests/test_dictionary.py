"""Dictionary (M1), vectors (M2) and ranking on small fixtures."""

import math

from pyspark.sql import Row
from pyspark.sql import functions as F

from wordtally.operators.dictionary import DictionaryBuilder, argument_for, class_idf
from wordtally.operators.ranking import dense_index
from wordtally.operators.vectorize import fit_transformation
from wordtally.options import TransformOptions


def corpus(spark, docs):
    rows = [Row(id=i, class_label=lab, words=w) for i, (lab, w) in enumerate(docs)]
    return spark.createDataFrame(rows, "id long, class_label string, words array<string>")


def test_class_idf(spark):
    v = spark.range(1).select(class_idf(F.lit(3), F.lit(1)).alias("x")).first().x
    assert abs(v - math.log(4 / 2)) < 1e-12


def test_argument_for_tie(spark):
    assert spark.range(1).select(argument_for(F.lit(2), F.lit(2)).alias("a")).first().a == "pos"
    assert spark.range(1).select(argument_for(F.lit(1), F.lit(2)).alias("a")).first().a == "neg"


def _words(n):
    return [f"w{chr(97 + i)}{chr(97 + i)}" for i in range(n)]


def test_dictionary_cut(spark):
    for n, want in ((7, 7), (8, 6)):
        ws = _words(n)
        docs = [("pos", ws)] * 3 + [("neg", ws[: n // 2])] * 2
        m = DictionaryBuilder(TransformOptions(min_tokens=1, dict_cut=3)).fit(corpus(spark, docs))
        d = m.dictionary.orderBy("idx").collect()
        assert m.size == want == len(d)
        assert [r.idx for r in d] == list(range(want))


def test_dictionary_counts_and_order(spark):
    docs = [("pos", ["good", "fine", "film"]), ("pos", ["good", "film"]), ("pos", ["good"]), ("neg", ["bad", "film"]),
            ("neg", ["bad"])]
    m = DictionaryBuilder(TransformOptions(min_tokens=2)).fit(corpus(spark, docs))
    assert (m.n_pos, m.n_neg) == (3, 2)
    d = {r.word: r for r in m.dictionary.collect()}
    assert set(d) == {"good", "film", "bad"}
    assert (d["film"].pos_df, d["film"].neg_df) == (2, 1)
    assert abs(d["good"].pos_idf - math.log(4 / 4)) < 1e-12 and abs(d["good"].neg_idf - math.log(3 / 1)) < 1e-12
    # words strong for neg come first (Q12)
    order = [r.word for r in m.dictionary.orderBy("idx").collect()]
    assert order == ["bad", "film", "good"]


def test_permuted_input_same_dictionary(spark):
    docs = [("pos", ["aaa", "bbb"]), ("neg", ["bbb", "ccc"]), ("pos", ["aaa", "ccc"]), ("neg", ["ccc"])]
    a = DictionaryBuilder(TransformOptions(min_tokens=1)).fit(corpus(spark, docs)).dictionary.collect()
    b = DictionaryBuilder(TransformOptions(min_tokens=1)).fit(corpus(spark, docs[::-1]).repartition(3)).dictionary
    assert sorted(a) == sorted(b.collect())


def test_dense_index_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("g")).repartition(7)
    got = dense_index(df, [F.col("k")], group="g", idx_col="i").collect()
    by_g = {}
    for r in got:
        by_g.setdefault(r.g, []).append((r.k, r.i))
    for g, pairs in by_g.items():
        pairs.sort()
        assert [i for _, i in pairs] == list(range(len(pairs)))


def test_tfidf_norm_and_presence(spark):
    docs = [("pos", ["aaa", "aaa", "bbb"]), ("neg", ["bbb", "ccc"]), ("pos", ["aaa", "ccc"]), ("neg", [])]
    c = corpus(spark, docs)
    tm = fit_transformation(c, TransformOptions(min_tokens=1, normalize=True))
    vals = tm.long_form(c).groupBy("id").agg(F.sum(F.col("value") ** 2).alias("n")).collect()
    assert all(abs(r.n - 1.0) < 1e-9 for r in vals)
    # tf-idf = tf * (ln((n+1)/(df+1)) + 1): aaa in doc 0: tf 2, df 2, n 4
    raw = fit_transformation(c, TransformOptions(min_tokens=1))
    idx = {r.word: r.idx for r in raw.dictmodel.dictionary.collect()}
    v = raw.long_form(c).where((F.col("id") == 0) & (F.col("idx") == idx["aaa"])).first().value
    assert abs(v - 2 * (math.log(5 / 3) + 1)) < 1e-12
    pres = fit_transformation(c, TransformOptions(min_tokens=1, boolean=True)).long_form(c)
    assert {r.value for r in pres.collect()} == {1.0}
    # the MLlib vector form carries the same values
    vec = {r.id: r.features for r in raw.vectors(c).collect()}
    assert abs(vec[0][idx["aaa"]] - v) < 1e-12
    assert vec[3].numNonzeros() == 0


def test_bag_without_broadcast(spark):
    docs = [("pos", ["aaa", "aaa", "bbb"]), ("neg", ["bbb", "ccc"]), ("pos", ["aaa", "ccc", "zzz"])]
    c = corpus(spark, docs)
    tm = fit_transformation(c, TransformOptions(min_tokens=2))
    want = sorted(map(tuple, tm.bag(c).collect()))
    spark.conf.set("wordtally.broadcast.maxRows", "1")
    try:
        got = sorted(map(tuple, tm.bag(c).collect()))
    finally:
        spark.conf.unset("wordtally.broadcast.maxRows")
    assert got == want and ("zzz" not in {r[1] for r in got})


def test_dense_index_hot_group(spark):
    # one group holds ~90% of the rows and spans many partitions
    df = spark.range(0, 20000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g"))
    got = dense_index(df.repartition(13), [F.col("k")], group="g", idx_col="i", count_col="n")
    hot = got.where(F.col("g") == "hot").orderBy("k").select("i", "n").collect()
    assert [r.i for r in hot] == list(range(18000)) and {r.n for r in hot} == {18000}
    assert got.where(F.col("g") == "cold").agg(F.max("i")).first()[0] == 1999


def test_cut_as_post_step(spark):
    ws = _words(9)
    docs = [("pos", ws[:7])] * 3 + [("neg", ws[3:])] * 2 + [("pos", ws[:2])]
    c = corpus(spark, docs)
    direct = fit_transformation(c, TransformOptions(min_tokens=1, dict_cut=3))
    derived = fit_transformation(c, TransformOptions(min_tokens=1)).cut(3)
    assert sorted(map(tuple, direct.dictmodel.dictionary.collect())) == sorted(map(tuple, derived.dictmodel.dictionary.collect()))
    assert sorted(map(tuple, direct.long_form(c).collect())) == sorted(map(tuple, derived.long_form(c).collect()))
    assert derived.size == direct.size == 6
