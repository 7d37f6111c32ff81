"""Transformations over merged rows against a count by hand."""

from collections import Counter

from wordtally.operators.merged import fit_merged, merged_selection
from wordtally.operators.registry import label_update
from wordtally.options import TransformOptions

TOK = "id long, seq long, symbol string, associated_date date, class_label string, error_cost double, success_gain double, sentences int, tokens int, words array<string>"


def tokenized(spark, rows):
    """(id, symbol, day, label, words) -> tokenized documents."""
    from datetime import date

    return spark.createDataFrame([(i, i, s, date(2020, 1, d), y, 1.0, 1.0, 1, len(w), w) for i, s, d, y, w in rows], TOK)


ROWS = [
    (1, "a", 1, "pos", ["good", "film", "good"]),
    (2, "a", 1, "neg", ["bad", "film"]),  # the last document of (a, 1): the merged row is neg
    (3, "a", 2, "pos", ["good", "story"]),
    (4, None, 2, "pos", ["story"]),
    (5, "b", 3, "none", ["unseen", "words"]),
    (6, "b", 4, "pos", []),
]


def test_merged_rows_through_the_transformation(spark):
    sel = merged_selection(tokenized(spark, ROWS))
    label = {r.id: (r.class_label, r.parts) for r in sel.rows.collect()}
    assert label == {1: ("neg", 2), 3: ("pos", 1), 4: ("pos", 1), 6: ("pos", 1)}
    want = {1: Counter(["good", "film", "good", "bad", "film"]), 3: Counter(["good", "story"]), 4: Counter(["story"])}
    assert {(r.id, r.word): r.tf for r in sel.bag.collect()} == {(d, w): n for d, c in want.items() for w, n in c.items()}
    tm = fit_merged(sel, TransformOptions(tfidf=False, min_tokens=1))
    got = {r.word: (r.pos_df, r.neg_df) for r in tm.dictmodel.dictionary.collect()}
    assert got == {"good": (1, 1), "film": (0, 1), "bad": (0, 1), "story": (2, 0)}
    assert (tm.dictmodel.n_pos, tm.dictmodel.n_neg, tm.n_corpus) == (3, 1, 4)
    idx = {r.word: r.idx for r in tm.dictmodel.dictionary.collect()}
    values = {(r.id, r.idx): r.value for r in tm.long_form(sel.rows).collect()}
    assert values == {(d, idx[w]): float(n) for d, c in want.items() for w, n in c.items()}


def test_merged_equals_plain_when_every_row_has_one_part(spark):
    from wordtally.operators.vectorize import fit_transformation

    rows = [(i, "s", i + 1, "pos" if i % 3 else "neg", [f"word{j}" for j in range(i % 5 + 1)]) for i in range(20)]
    opts = TransformOptions(min_tokens=2)
    tok = tokenized(spark, rows)
    sel = merged_selection(tok, opts)
    merged, plain = fit_merged(sel, opts), fit_transformation(tok, opts)

    def table(df):
        return sorted(map(tuple, df.collect()))

    assert table(merged.dictmodel.dictionary) == table(plain.dictmodel.dictionary)
    assert table(merged.long_form(sel.rows)) == table(plain.long_form(tok))


def test_label_row_with_a_selector_drops_the_tokenization(spark):
    reg = spark.createDataFrame(
        [(1, "u1", "html", "none", 1.0, 1.0, None, 11), (2, "u2", "html", "none", 1.0, 1.0, None, 12), (3, "u3", "txt", "none", 1.0, 1.0, None, 13)],
        "id long, original_url string, file_type string, class_label string, error_cost double, success_gain double, xpath string, tokenization_id long",
    )
    lab = spark.createDataFrame(
        [("u1", "pos", 2.0, 3.0, 1, "article"), ("u2", "neg", 2.0, 3.0, 2, None), ("u3", "neg", 2.0, 3.0, 3, "article")],
        "path string, class_label string, error_cost double, success_gain double, seq long, xpath string",
    )
    out = {r.id: (r.class_label, r.tokenization_id) for r in label_update(reg, lab).collect()}
    assert out == {1: ("pos", None), 2: ("neg", 12), 3: ("neg", 13)}


def plain_negations(words, trigger):
    out, i = [], 0
    while i < len(words):
        if words[i] == trigger and i + 1 < len(words):
            out.append(f"{trigger} {words[i + 1]}")
            i += 2
        else:
            out.append(words[i])
            i += 1
    return out


def test_negations_join_over_the_borders_of_parts(spark):
    import random

    rng = random.Random(3)
    rows = []
    for symbol, n in [("hot", 400), ("a", 7), ("b", 1), (None, 9), ("c", 40)]:
        for _ in range(n):
            words = [] if rng.random() < 0.2 else rng.choices(["not", "good", "bad"], [4 if symbol != "c" else 99, 1, 1], k=rng.randint(1, 4))
            rows.append((len(rows), symbol, 1 + len(rows) % 2, "pos", words))
    sel = merged_selection(tokenized(spark, rows), TransformOptions(neg=True))
    got = {}
    keys = {r.id: (r.symbol, r.associated_date.day) for r in sel.rows.collect()}
    for r in sel.bag.collect():
        got.setdefault(keys[r.id], Counter())[r.word] = r.tf
    want = {}
    for i, symbol, day, _, words in sorted(rows, key=lambda r: -r[0]):  # the newest part first
        want.setdefault((symbol, day), []).extend(words)
    want = {k: Counter(plain_negations(w, "not")) for k, w in want.items() if w}
    assert got == want


def test_selection_by_date_and_symbol(spark):
    tok = tokenized(spark, ROWS)
    assert [r.id for r in merged_selection(tok, start_date="2020-01-02", end_date="2020-01-03").rows.orderBy("id").collect()] == [3, 4]
    assert [r.id for r in merged_selection(tok, symbols=["a"]).rows.orderBy("id").collect()] == [1, 3]
    assert {r.word for r in merged_selection(tok, symbols=["b"]).bag.collect()} == set()


def test_vectors_and_other_merged_rows(spark):
    sel = merged_selection(tokenized(spark, ROWS))
    tm = fit_merged(sel, TransformOptions(tfidf=False, min_tokens=1))
    sums = {r.id: sum(r.features.values) for r in tm.vectors(sel).collect()}
    assert sums == {1: 5.0, 3: 2.0, 4: 1.0, 6: 0.0}
    other = merged_selection(tokenized(spark, [(50, "z", 1, "pos", ["good", "new"]), (51, "z", 1, "pos", ["good"])]))
    assert [(r.id, r.value) for r in tm.long_form(other).collect()] == [(50, 2.0)]
    small = fit_merged(sel, TransformOptions(min_tokens=1, reduction=True, components=2))
    assert small.vectors(sel).count() == 4 and small.n_features == 2


def test_the_words_are_not_shuffled_to_join_parts(spark):
    """parts that neither take nor give a word are told apart without a shuffle of their words; ids that come twice meet each other."""
    from wordtally.operators.merged import join_across_parts

    rows = [(1, "a", 1, "pos", ["b", "the"]), (2, "a", 1, "pos", ["x", "the", "y", "the"]), (3, "a", 1, "pos", ["z"]), (4, "b", 1, "neg", ["the"]),
            (5, "c", 1, "neg", []), (6, "d", 1, "neg", ["k", "the"]), (6, "d", 1, "neg", ["k", "the"])]
    # newest first: 3, 2, 1: the last word of 2 takes the first of 1
    out = join_across_parts(tokenized(spark, rows), "the")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    got = sorted((r.id, r.words) for r in out.collect())
    assert got[:5] == [(1, ["the b", "the"]), (2, ["x", "the y"]), (3, ["z"]), (4, ["the"]), (5, [])]
    assert [i for i, _ in got[5:]] == [6] * 4
