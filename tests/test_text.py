"""Tokenizer, filters and negations on hand-written rows (FIXTURES.md)."""

from pyspark.sql import functions as F

from wordtally.functions import text as T


def one(spark, expr, value, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("r")).first()["r"]


def test_negation_cases(spark):
    cases = [
        (["not", "not", "good"], ["not not", "good"]),
        (["not", "not", "not", "x", "not"], ["not not", "not x", "not"]),
        (["not"], ["not"]),
        (["good", "not"], ["good", "not"]),
        (["knot", "good", "not", "x"], ["knot", "good", "not x"]),
        ([], []),
    ]
    for toks, want in cases:
        assert one(spark, T.join_negations(F.col("x")), toks, "x array<string>") == want


def test_token_filter(spark):
    kept = {"a-b": "a-b", "ab": "ab", "A_b": "a_b", "n't": "not"}
    for tok, want in kept.items():
        assert one(spark, T.filter_token(F.col("x")), tok) == want
    for tok in ["a", "b2b", "a--b", "a-b-c", "été", "it's"]:
        assert one(spark, T.filter_token(F.col("x")), tok) is None


def test_whole_text_contractions(spark):
    assert one(spark, T.sentence_words(F.col("x")), "I don't. It's bad") == [["do", "not"], ["it", "bad"]]
    assert one(spark, T.words(F.col("x")), "can't won't") == ["ca", "not", "wo", "not"]


def test_words_match_token_filter(spark):
    text = "Alpha, beta-gamma; DELTA! x y2 naïve under_score (paren) [br] a--b e-f-g Kelvin"
    words = one(spark, T.words(F.col("x")), text)
    assert words == ["alpha", "beta-gamma", "delta", "under_score", "paren", "br"]


def test_empty_text(spark):
    df = spark.createDataFrame([("",), (None,), ("   ",)], "x string")
    rows = df.select(T.sentence_count("x").alias("s"), F.size(T.words("x")).alias("t")).collect()
    assert [(r.s, r.t) for r in rows] == [(0, 0), (0, 0), (0, 0)]


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("x")), "  A b.  C d! e? f ") == ["A b.", "C d!", "e?", "f"]
    assert one(spark, T.sentence_count(F.col("x")), "A b.  C d! e? f ") == 4
    assert one(spark, T.sentence_count(F.col("x")), "end.") == 1


def test_stopwords_and_length(spark):
    assert one(spark, T.remove_stopwords(F.col("x")), ["the", "cat", "and", "dog"], "x array<string>") == ["cat", "dog"]
    assert one(spark, T.min_length(F.col("x"), 3), ["ab", "abc", "not x"], "x array<string>") == ["abc", "not x"]


def test_lemma_table(spark):
    from wordtally.functions.lemma import lemma_table

    vocab = spark.createDataFrame([(w,) for w in ["cats", "cat", "boxes", "box", "making", "make", "men", "man", "fly", "flies"]], "word string")
    got = {r.form: r.lemma for r in lemma_table(vocab).collect()}
    assert got == {"cats": "cat", "boxes": "box", "making": "make", "flies": "fly"}


def test_apply_lemmas(spark):
    from wordtally.functions.lemma import apply_lemmas

    docs = spark.createDataFrame([(1, "pos", ["cats", "sat", "boxes", "cats"]), (2, "neg", [])],
                                 "id long, class_label string, words array<string>")
    table = spark.createDataFrame([("cats", 1, "cat"), ("boxes", 1, "box")], "form string, pos_rank int, lemma string")
    got = {r.id: r.words for r in apply_lemmas(docs, table).collect()}
    assert got == {1: ["cat", "sat", "box", "cat"], 2: []}
