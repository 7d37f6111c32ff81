"""Folds, ensembles, metrics, kNN against brute force, bundles, HTML."""

import math
import os

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from wordtally.operators import evaluate as E
from wordtally.operators import learners as LR


def test_ensemble_rule_six_votes(spark):
    df = spark.createDataFrame([(s,) for s in [0, 2, 4, 6, -4]], "s int")
    m, b, a = E.ensemble_rule(F.col("s"), 6)
    rows = df.select(m.alias("m"), b.alias("b"), a.alias("a")).collect()
    assert [r.m for r in rows] == [0, 1, 1, 1, -1]
    assert [r.b for r in rows] == [0, 0, 1, 1, -1]
    assert [r.a for r in rows] == [0, 0, 0, 1, 0]


def test_gain(spark):
    votes = spark.createDataFrame([Row(id=1, fold=0, learner="x", vote=1, y=1), Row(id=2, fold=0, learner="x", vote=1, y=-1)])
    folds = spark.createDataFrame([Row(id=1, success_gain=5.0, error_cost=1.0), Row(id=2, success_gain=1.0, error_cost=3.0)])
    m = {r.cls: r for r in E.fold_metrics(votes, folds).collect()}
    assert m[1].gain == 2.0 and m[1].supposed == 2 and m[1].precision == 0.5
    assert m[-1].no_decision == 0.0 and m[-1].support == 1
    assert m[-1].gain_per_supposition is None  # no neg call: no ratio (Q11)


def test_folds_stratified(spark):
    ts = spark.createDataFrame([Row(id=i, y=1 if i % 3 else -1, in_dictionary=False) for i in range(137)])
    f = E.assign_folds(ts).collect()
    assert len({r.id for r in f}) == 137
    for y in (1, -1):
        sizes = np.bincount([r.fold for r in f if r.y == y], minlength=10)
        assert sizes.max() - sizes.min() <= 1


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    n, dim = 60, 12
    x = (rng.random((n, dim)) * (rng.random((n, dim)) < 0.4)).round(3)
    x[7] = x[3]  # an exact copy: ties break by id
    ys = rng.choice([1, -1], n)
    fold = np.arange(n) % 4
    feats = spark.createDataFrame(
        [Row(id=i, idx=j, value=float(x[i, j])) for i in range(n) for j in range(dim) if x[i, j] > 0]
    )
    folds = spark.createDataFrame([Row(id=i, y=int(ys[i]), fold=int(fold[i]), in_dictionary=bool(i % 5 == 0)) for i in range(n)])
    got = LR.knn_neighbours(feats, folds, k=5, block_rows=16).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.qid, []).append((r.d2, r.tid))
    for q in range(n):
        if q % 5 == 0:
            assert q not in mine
            continue
        cand = sorted((round(float(((x[q] - x[t]) ** 2).sum()), 6), t) for t in range(n) if fold[t] != fold[q])[:5]
        assert [t for _, t in sorted(mine[q])] == [t for _, t in cand]
        assert all(abs(a - b) < 1e-6 for (a, _), (b, _) in zip(sorted(mine[q]), cand))


def test_naive_bayes_matches_formula(spark):
    # two features, 4 training docs, one test doc
    pres = spark.createDataFrame([Row(id=1, idx=0), Row(id=2, idx=0), Row(id=2, idx=1), Row(id=3, idx=1), Row(id=5, idx=0)])
    folds = spark.createDataFrame(
        [Row(id=i, y=y, fold=-1, in_dictionary=True) for i, y in [(1, 1), (2, 1), (3, -1), (4, -1)]]
        + [Row(id=5, y=0, fold=0, in_dictionary=False)]
    )
    s = LR.naive_bayes_scores(pres, folds, 2, n_folds=1).first()
    # pos: prior 1/2, p0 = (2+1)/(2+2), p1 = (1+1)/4 ; neg: p0 = 1/4, p1 = 2/4
    pos = math.log(0.5) + math.log(3 / 4) + math.log(1 - 2 / 4)
    neg = math.log(0.5) + math.log(1 / 4) + math.log(1 - 2 / 4)
    assert abs(s.jll_pos - pos) < 1e-12 and abs(s.jll_neg - neg) < 1e-12


def test_scale(spark):
    long = spark.createDataFrame([Row(id=i, dim=0, value=float(v)) for i, v in enumerate([1, 2, 3, 4])])
    out = sorted(r.value for r in LR.standard_scale(long).collect())
    assert abs(np.mean(out)) < 1e-12 and abs(np.std(out) - 1) < 1e-12


def test_bundle_save_load_predict(spark, tmpdir_path):
    from wordtally.operators import predict as P
    from wordtally.options import TransformOptions

    docs = [("pos", ["good", "fine", "film"]), ("pos", ["good", "film", "nice"]), ("pos", ["good", "nice"]),
            ("neg", ["bad", "film", "awful"]), ("neg", ["bad", "awful"]), ("neg", ["bad", "dull"])]
    sel = spark.createDataFrame(
        [Row(id=i, class_label=lab, words=w, success_gain=1.0, error_cost=1.0) for i, (lab, w) in enumerate(docs)]
    )
    b = P.train_bundle("m", sel, TransformOptions(min_tokens=1), ml_voters=["svm_linear"])
    path = os.path.join(tmpdir_path, "bundle")
    b.save(path)
    b2 = P.ModelBundle.load(spark, path)
    samples = spark.createDataFrame([Row(id=100, words=["good", "nice", "film"]), Row(id=101, words=["bad", "awful"])])
    v1 = sorted(map(tuple, P.predict_votes(b, samples).collect()))
    v2 = sorted(map(tuple, P.predict_votes(b2, samples).collect()))
    assert v1 == v2
    nb = {r.id: r.vote for r in P.predict_votes(b2, samples).where(F.col("learner") == "naive_bayes").collect()}
    assert nb == {100: 1, 101: -1}
    rep = P.word_report(b2, samples).where(F.col("id") == 101).orderBy("idx").collect()
    assert {r.word for r in rep} == {"bad", "awful"} and all(r.argument_for == "neg" for r in rep)


def test_prediction_with_training_ids(spark):
    """Samples whose ids also occur in training are scored on their own words; the projected voter is projected at prediction."""
    from wordtally.operators import predict as P
    from wordtally.options import TransformOptions

    docs = [("pos", ["good", "fine", "film"]), ("pos", ["good", "nice"]), ("neg", ["bad", "film", "awful"]), ("neg", ["bad", "dull"])]
    sel = spark.createDataFrame([Row(id=i, class_label=lab, words=w, success_gain=1.0, error_cost=1.0) for i, (lab, w) in enumerate(docs)])
    b = P.train_bundle("m", sel, TransformOptions(min_tokens=1), ml_voters=["svm_rff"])
    words = [["bad", "awful"], ["bad", "dull"], ["good", "nice"]]
    votes = []
    for shift in (0, 1000):
        samples = spark.createDataFrame([Row(id=shift + i, words=w) for i, w in enumerate(words)])
        votes.append(sorted((r.id - shift, r.learner, r.vote) for r in P.predict_votes(b, samples).collect()))
    assert votes[0] == votes[1]
    assert [v for i, name, v in votes[0] if name == "naive_bayes"] == [-1, -1, 1]


def test_html(spark):
    from wordtally.functions import html as H

    page = ("<html><head><title>T&amp;C</title><script>var a='<p>';</script></head><body><!-- c --><p>It&rsquo;s "
            "<b>bold</b></p><article>Main &#65; text</article><style>p{}</style></body></html>")
    df = spark.createDataFrame([(page,)], "h string")
    r = df.select(H.html_to_text(F.col("h")).alias("t"), H.html_block(F.col("h"), "article").alias("a"),
                  H.html_block(F.col("h"), "table").alias("n")).first()
    assert r.t == "T&CIt's boldMain A textp{}"
    assert r.a == "Main A text" and r.n == ""


def test_scan_files(spark, tmpdir_path):
    from wordtally.sources.files import scan_files, to_text

    with open(os.path.join(tmpdir_path, "a.txt"), "w") as f:
        f.write("plain text’s")
    with open(os.path.join(tmpdir_path, "b.html"), "w") as f:
        f.write("<p>hi <i>there</i></p>")
    with open(os.path.join(tmpdir_path, "c.pdf"), "wb") as f:
        f.write(b"%PDF-1.4")
    got = {os.path.basename(r.path): r for r in to_text(scan_files(spark, tmpdir_path)).collect()}
    assert got["a.txt"].text == "plain text's" and got["b.html"].text == "hi there"
    assert got["c.pdf"].text is None and got["c.pdf"].error


def test_rff_features_approximate_kernel(spark):
    rng = np.random.default_rng(5)
    x = (rng.random((6, 8)) * (rng.random((6, 8)) < 0.6)).round(3)
    x[5] = 0.0  # an empty document
    feats = spark.createDataFrame([Row(id=i, idx=j, value=float(x[i, j])) for i in range(6) for j in range(8) if x[i, j] > 0])
    ids = spark.createDataFrame([Row(id=i) for i in range(6)])
    z = {r.id: np.asarray(r.z) for r in LR.rff_features(feats, 8, n_components=4096, gamma=0.5, ids=ids).collect()}
    for a in range(5):
        for b in range(5):
            k = math.exp(-0.5 * ((x[a] - x[b]) ** 2).sum())
            assert abs(float(z[a] @ z[b]) - k) < 0.08
    assert abs(float(z[5] @ z[5]) - 1.0) < 0.08  # the empty document is projected too: k(0, 0) = 1


def test_ml_voters_on_separable_data(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(9)
    n = 80
    ys = np.where(np.arange(n) % 2 == 0, 1, -1)
    x = rng.normal(0, 0.3, (n, 3)) + np.outer(ys, [2.0, -2.0, 0.0])
    vectors = spark.createDataFrame([Row(id=i, features=Vectors.dense(x[i].tolist())) for i in range(n)])
    folds = spark.createDataFrame(
        [Row(id=i, y=int(ys[i]), fold=int(i % 4), in_dictionary=False, error_cost=1.0 + (i % 3)) for i in range(n)]
    )
    for voter, kw in [(LR.MLVoter("svm_linear", True), {}), (LR.MLVoter("svm_linear", True), {"weight_col": "error_cost"}),
                      (LR.MLVoter("boosting", False), {}), (LR.MLVoter("svm_linear", True), {"scale": True})]:
        v = LR.ml_fold_votes(voter, vectors, folds, 3, n_folds=4, **kw).collect()
        assert len(v) == n
        assert sum(r.vote == r.y for r in v) >= 0.95 * n


def test_html_block_by_row(spark):
    from wordtally.functions import html as H

    page = "<nav>menu</nav><article>Main</article><table>T</table>"
    df = spark.createDataFrame([(page, "article"), (page, None), (page, ""), (page, "tab)le"), (page, "aside")], "h string, x string")
    got = [r.t for r in df.select(H.html_block_by(F.col("h"), F.col("x")).alias("t")).collect()]
    assert got == ["Main", "menuMainT", "menuMainT", "T", ""]
