"""Evaluation queries: M12 with S8, J3, J4, F9, F11, W4, W7, M7, M9, M11,
G9-G17, X18, X19, U3; rows-only keys for the pyspark.ml voters."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import functions as F

from wordtally.operators import evaluate as E
from wordtally.operators import learners as LR
from wordtally.operators import sgd as SGD
from wordtally.operators.vectorize import fit_transformation
from wordtally.options import TransformOptions
from wordtally.plans import query
from wordtally.plans import sql as S
from wordtally.plans.q_vectorize import bag_ctes
from wordtally.session import ensure_checkpoint_dir, reliable_checkpoint
from wordtally.sources.sinks import read_samples, write_samples
from wordtally.sources.tables import labelled_selection

SEED = "42"
CV_OPTS = TransformOptions(ratio=0.5, seed=SEED)
O_VOTERS = ["naive_bayes", "naive_bayes_weighted", "knn"]
ALL_VOTERS = ["svm_linear", "svm_rff", "sgd_linear", "knn", "naive_bayes", "boosting"]


class CVContext:
    """Selection, transformation, samples and folds shared by the CV queries."""

    def __init__(self, spark, sf_dir):
        self.sel = labelled_selection(spark, sf_dir)
        self.tm = fit_transformation(self.sel, CV_OPTS)
        # K3: the samples matrix (long form) is materialised once
        self.feats = reliable_checkpoint(self.tm.long_form(self.sel))
        ts = E.training_set(self.sel.select("id"), self.sel, self.tm.dictmodel.sample_ids)
        self.folds = reliable_checkpoint(E.assign_folds(ts))
        self.tests = E.test_rows(self.folds)
        self.presence = self.feats.where(F.col("value") > 0).select("id", "idx")
        self._votes = {}

    def nb_scores(self, weighted: bool):
        """Scores of both naive Bayes weightings, fitted together once."""
        if "nb" not in self._votes:
            self._votes["nb"] = reliable_checkpoint(
                LR.naive_bayes_scores_multi(
                    self.presence, self.folds, self.tm.size, {"naive_bayes": None, "naive_bayes_weighted": "error_cost"}
                )
            )
        name = "naive_bayes_weighted" if weighted else "naive_bayes"
        return self._votes["nb"].where(F.col("learner") == name).drop("learner")

    def knn(self):
        if "knn" not in self._votes:
            neigh = LR.knn_neighbours(self.feats, self.folds)
            self._votes["knn"] = reliable_checkpoint(LR.knn_votes(neigh))
        return self._votes["knn"]

    def o_votes(self):
        """Votes of the SQL-checkable voters, their ensembles and the baselines."""
        if "o" not in self._votes:
            nb = LR.naive_bayes_votes(self.nb_scores(False), "naive_bayes")
            nbw = LR.naive_bayes_votes(self.nb_scores(True), "naive_bayes_weighted")
            voters = nb.unionByName(nbw).unionByName(self.knn())
            ens = E.ensemble_votes(voters, O_VOTERS)
            base = E.baseline_votes(self.tests, SEED)
            self._votes["o"] = reliable_checkpoint(voters.unionByName(ens).unionByName(base))
        return self._votes["o"]


@lru_cache(maxsize=4)
def _ctx(spark, sf_dir) -> CVContext:
    return CVContext(spark, sf_dir)


def ctx(spark, sf_dir) -> CVContext:
    return _ctx(spark, sf_dir)


# ------------------------------------------------------------------- SQL
def _cv_ctes(source: list[str] | None = None) -> list[str]:
    """CTEs of the cross-validation over the bag of ``source`` (default: the labelled documents)."""
    nb_blocks = []
    for tag, w in (("nb", "1.0"), ("nbw", "error_cost")):
        nb_blocks += [
            f"{tag}_w AS (SELECT id, y, fold, in_dictionary, CAST({w} AS DOUBLE) AS w FROM folds)",
            f"{tag}_cf AS (SELECT fold, y, sum(w) AS cw_f FROM {tag}_w GROUP BY fold, y)",
            f"{tag}_ct AS (SELECT y, sum(w) AS cw_t FROM {tag}_w GROUP BY y)",
            f"""{tag}_cls AS (SELECT g.fold, g.y, coalesce(t.cw_t, 0) - coalesce(f.cw_f, 0) AS cw
                FROM grid_fc g LEFT JOIN {tag}_ct t ON t.y = g.y LEFT JOIN {tag}_cf f ON f.fold = g.fold AND f.y = g.y)""",
            f"{tag}_cls2 AS (SELECT *, ln(cw / sum(cw) OVER (PARTITION BY fold)) AS log_prior FROM {tag}_cls)",
            f"""{tag}_ff AS (SELECT n.fold, n.y, p.idx, sum(n.w) AS fw_f FROM presence p JOIN {tag}_w n ON n.id = p.id
                GROUP BY n.fold, n.y, p.idx)""",
            f"{tag}_ft AS (SELECT y, idx, sum(fw_f) AS fw_t FROM {tag}_ff GROUP BY y, idx)",
            f"""{tag}_st AS (SELECT g.fold, g.y, g.idx, c.log_prior,
                   (coalesce(t.fw_t, 0) - coalesce(f.fw_f, 0) + 1.0) / (c.cw + 2.0) AS p
                FROM grid g LEFT JOIN {tag}_ft t ON t.y = g.y AND t.idx = g.idx
                LEFT JOIN {tag}_ff f ON f.fold = g.fold AND f.y = g.y AND f.idx = g.idx
                JOIN {tag}_cls2 c ON c.fold = g.fold AND c.y = g.y)""",
            f"{tag}_base AS (SELECT fold, y, max(log_prior) + sum(ln(1 - p)) AS base FROM {tag}_st GROUP BY fold, y)",
            f"""{tag}_pd AS (SELECT t.id, s.y, sum(ln(s.p) - ln(1 - s.p)) AS ds
                FROM presence p JOIN tests t ON t.id = p.id JOIN {tag}_st s ON s.fold = t.fold AND s.idx = p.idx
                GROUP BY t.id, s.y)""",
            f"""{tag}_sc AS (SELECT t.id, t.fold, t.y AS true_y, b.y, b.base + coalesce(d.ds, 0) AS jll
                FROM tests t JOIN {tag}_base b ON b.fold = t.fold LEFT JOIN {tag}_pd d ON d.id = t.id AND d.y = b.y)""",
            f"""{tag}_scores AS (SELECT id, fold, true_y AS y, max(CASE WHEN y = 1 THEN jll END) AS jll_pos,
                   max(CASE WHEN y = -1 THEN jll END) AS jll_neg FROM {tag}_sc GROUP BY id, fold, true_y)""",
            f"""{tag}_votes AS (SELECT id, fold, CASE WHEN round(jll_pos, 5) > round(jll_neg, 5) THEN 1 ELSE -1 END AS vote, y
                FROM {tag}_scores)""",
        ]
    return (source or bag_ctes(CV_OPTS)) + [
        "feat AS (SELECT b.id, b.idx, b.tf * i.idf AS value FROM bag b JOIN idf i ON b.idx = i.idx)",
        "presence AS (SELECT id, idx FROM feat WHERE value > 0)",
        """ts AS (SELECT s.id, CASE WHEN s.class_label = 'pos' THEN 1 ELSE -1 END AS y, s.success_gain, s.error_cost,
              s.id IN (SELECT id FROM smp) AS in_dictionary FROM sel s)""",
        "folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY id) - 1) % 10 AS INTEGER) AS fold FROM ts)",
        "tests AS (SELECT * FROM folds WHERE NOT in_dictionary)",
        "grid_fc AS (SELECT CAST(r.range AS INTEGER) AS fold, c.y FROM range(10) r, (VALUES (1), (-1)) c(y))",
        "grid AS (SELECT d.idx, g.fold, g.y FROM dict d, grid_fc g)",
    ] + nb_blocks + [
        "fn AS (SELECT f.id, coalesce(sum(x.value * x.value), 0) AS n2 FROM folds f LEFT JOIN feat x ON x.id = f.id GROUP BY f.id)",
        """dots AS (SELECT a.id AS qid, b.id AS tid, sum(a.value * b.value) AS dot
             FROM feat a JOIN tests q ON q.id = a.id JOIN feat b ON b.idx = a.idx JOIN folds t ON t.id = b.id AND t.fold <> q.fold
             GROUP BY a.id, b.id)""",
        """dd AS (SELECT q.id AS qid, q.fold AS qfold, q.y AS qy, t.id AS tid, t.y AS ty,
               round(greatest(nq.n2 + nt.n2 - 2 * coalesce(d.dot, 0), 0), 6) AS d2
             FROM tests q JOIN folds t ON q.fold <> t.fold JOIN fn nq ON nq.id = q.id JOIN fn nt ON nt.id = t.id
             LEFT JOIN dots d ON d.qid = q.id AND d.tid = t.id)""",
        "nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, tid) AS rn FROM dd) WHERE rn <= 11)",
        """kw AS (SELECT *, CASE WHEN max(CASE WHEN d2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) = 1
                         THEN CASE WHEN d2 = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / sqrt(d2) END AS wt FROM nn)""",
        """knn_votes AS (SELECT qid AS id, qfold AS fold,
               CASE WHEN round(sum(CASE WHEN ty = 1 THEN wt ELSE 0 END), 6) > round(sum(CASE WHEN ty = -1 THEN wt ELSE 0 END), 6)
                    THEN 1 ELSE -1 END AS vote, qy AS y FROM kw GROUP BY qid, qfold, qy)""",
        """voters AS (SELECT id, fold, 'naive_bayes' AS learner, vote, y FROM nb_votes
             UNION ALL SELECT id, fold, 'naive_bayes_weighted', vote, y FROM nbw_votes
             UNION ALL SELECT id, fold, 'knn', vote, y FROM knn_votes)""",
        f"""ens_sum AS (SELECT id, fold, y, sum(vote) AS s FROM voters GROUP BY id, fold, y)""",
        f"""ens AS (
             SELECT id, fold, 'ensemble_majority' AS learner,
                    CASE WHEN abs(s) > 0 THEN (CASE WHEN s > 0 THEN 1 ELSE -1 END) ELSE 0 END AS vote, y FROM ens_sum
             UNION ALL SELECT id, fold, 'ensemble_all_but_one',
                    CASE WHEN abs(s) >= {max(len(O_VOTERS) - 2, 1)} THEN (CASE WHEN s > 0 THEN 1 ELSE -1 END) ELSE 0 END, y FROM ens_sum
             UNION ALL SELECT id, fold, 'ensemble_all',
                    CASE WHEN abs(s) = {len(O_VOTERS)} THEN (CASE WHEN s > 0 THEN 1 ELSE -1 END) ELSE 0 END, y FROM ens_sum)""",
        f"""base AS (
             SELECT id, fold, 'always_pos' AS learner, 1 AS vote, y FROM tests
             UNION ALL SELECT id, fold, 'always_neg', -1, y FROM tests
             UNION ALL SELECT id, fold, 'random', {S.random_vote('id', SEED)}, y FROM tests)""",
        "votes AS (SELECT * FROM voters UNION ALL SELECT * FROM ens UNION ALL SELECT * FROM base)",
        """m AS (SELECT v.fold, v.learner,
             count(*) FILTER (WHERE v.y = 1) AS s_p, count(*) FILTER (WHERE v.y = -1) AS s_n, count(*) FILTER (WHERE v.y = 0) AS s_z,
             count(*) FILTER (WHERE v.vote = 1) AS t_p, count(*) FILTER (WHERE v.vote = -1) AS t_n, count(*) FILTER (WHERE v.vote = 0) AS t_z,
             count(*) FILTER (WHERE v.vote = 1 AND v.y = 1) AS h_p, count(*) FILTER (WHERE v.vote = -1 AND v.y = -1) AS h_n,
             count(*) FILTER (WHERE v.vote = 0 AND v.y = 0) AS h_z,
             count(*) FILTER (WHERE v.vote = 0 AND v.y = 1) AS nd_p, count(*) FILTER (WHERE v.vote = 0 AND v.y = -1) AS nd_n,
             sum(CASE WHEN v.vote = 1 AND v.y = 1 THEN f.success_gain WHEN v.vote = 1 AND v.y = -1 THEN -f.error_cost ELSE 0.0 END) AS g_p,
             sum(CASE WHEN v.vote = -1 AND v.y = -1 THEN f.success_gain WHEN v.vote = -1 AND v.y = 1 THEN -f.error_cost ELSE 0.0 END) AS g_n
           FROM votes v JOIN folds f ON f.id = v.id GROUP BY v.fold, v.learner)""",
        """mp AS (SELECT *, CASE WHEN t_p > 0 THEN h_p / t_p ELSE 0.0 END AS pr_p, CASE WHEN t_n > 0 THEN h_n / t_n ELSE 0.0 END AS pr_n,
                         CASE WHEN t_z > 0 THEN h_z / t_z ELSE 0.0 END AS pr_z FROM m)""",
        """metrics AS (
             SELECT fold, learner, 1 AS cls, pr_p AS precision, CASE WHEN s_p > 0 THEN h_p / s_p ELSE 0.0 END AS recall, s_p AS support,
                    CASE WHEN s_p > 0 THEN nd_p / s_p END AS no_decision, t_p AS supposed, g_p AS gain,
                    CASE WHEN t_p > 0 THEN g_p / t_p END AS gain_per_supposition,
                    CASE WHEN s_p + s_n > 0 THEN (pr_p * s_p + pr_n * s_n) / (s_p + s_n) END AS precision_total FROM mp
             UNION ALL
             SELECT fold, learner, 0, pr_z, CASE WHEN s_z > 0 THEN h_z / s_z ELSE 0.0 END, s_z, 0.0, t_z, 0.0,
                    CASE WHEN t_z > 0 THEN 0.0 / t_z END,
                    CASE WHEN s_p + s_n > 0 THEN (pr_p * s_p + pr_n * s_n) / (s_p + s_n) END FROM mp
             UNION ALL
             SELECT fold, learner, -1, pr_n, CASE WHEN s_n > 0 THEN h_n / s_n ELSE 0.0 END, s_n,
                    CASE WHEN s_n > 0 THEN nd_n / s_n END, t_n, g_n, CASE WHEN t_n > 0 THEN g_n / t_n END,
                    CASE WHEN s_p + s_n > 0 THEN (pr_p * s_p + pr_n * s_n) / (s_p + s_n) END FROM mp)""",
    ]


def cv_sql(select: str) -> str:
    return S.with_ctes(*_cv_ctes()) + select


def _r(col, d=6):
    return F.round(col, d).alias(col)


# --------------------------------------------------------------- queries
@query(
    "training_set",
    cv_sql("SELECT id, CAST(y AS INTEGER) AS y, success_gain, error_cost, in_dictionary FROM ts"),
)
def training_set(spark, sf_dir):
    """S8 with J3 (label, gain, cost by id), J4 (dictionary mark), F9 (+1/-1)."""
    c = ctx(spark, sf_dir)
    return c.folds.select("id", "y", "success_gain", "error_cost", "in_dictionary")


@query(
    "samples_roundtrip",
    cv_sql("SELECT ts.id, ts.in_dictionary, f.idx, round(f.value, 6) AS value, (SELECT count(*) FROM dict) AS size FROM ts LEFT JOIN feat f ON f.id = ts.id"),
)
def samples_roundtrip(spark, sf_dir):
    """K3 + S8: the samples written and read back; a document without dictionary words keeps its row."""
    c = ctx(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/samples/{uuid.uuid4().hex}"
    write_samples(c.feats, c.tm.dictmodel.sample_ids, path, c.sel.select("id"), size=c.tm.size)
    values, docs = read_samples(spark, path)
    return docs.join(values, "id", "left").select("id", "in_dictionary", "idx", _r("value"), "size")


@query("cv_folds", cv_sql("SELECT id, CAST(y AS INTEGER) AS y, fold, in_dictionary FROM folds"))
def cv_folds(spark, sf_dir):
    """Stratified round-robin folds."""
    return ctx(spark, sf_dir).folds.select("id", "y", "fold", "in_dictionary")


@query(
    "naive_bayes",
    cv_sql(
        """SELECT s.id, s.fold, CAST(s.y AS INTEGER) AS y, round(s.jll_pos, 5) AS jll_pos, round(s.jll_neg, 5) AS jll_neg,
       CAST(v.vote AS INTEGER) AS vote FROM nb_scores s JOIN nb_votes v ON v.id = s.id"""
    ),
)
def naive_bayes(spark, sf_dir):
    """M9: Bernoulli naive Bayes scores and votes for every test document."""
    s = ctx(spark, sf_dir).nb_scores(False)
    v = LR.naive_bayes_votes(s).select("id", "vote")
    return s.join(v, "id").select("id", "fold", "y", _r("jll_pos", 5), _r("jll_neg", 5), "vote")


@query(
    "naive_bayes_weighted",
    cv_sql(
        """SELECT s.id, s.fold, CAST(s.y AS INTEGER) AS y, round(s.jll_pos, 5) AS jll_pos, round(s.jll_neg, 5) AS jll_neg,
       CAST(v.vote AS INTEGER) AS vote FROM nbw_scores s JOIN nbw_votes v ON v.id = s.id"""
    ),
)
def naive_bayes_weighted(spark, sf_dir):
    """M9 + M11: sample weights = error cost."""
    s = ctx(spark, sf_dir).nb_scores(True)
    v = LR.naive_bayes_votes(s, "naive_bayes_weighted").select("id", "vote")
    return s.join(v, "id").select("id", "fold", "y", _r("jll_pos", 5), _r("jll_neg", 5), "vote")


@query("knn_votes", cv_sql("SELECT id, fold, CAST(y AS INTEGER) AS y, CAST(vote AS INTEGER) AS vote FROM knn_votes"))
def knn_votes(spark, sf_dir):
    """11 nearest training documents, distance-weighted vote."""
    return ctx(spark, sf_dir).knn().select("id", "fold", "y", "vote")


@query(
    "knn_neighbours",
    cv_sql("SELECT qid, tid, CAST(rn AS INTEGER) AS rank, round(d2, 6) AS d2 FROM nn"),
)
def knn_neighbours(spark, sf_dir):
    """The neighbour lists themselves (rank 1..11 per test document)."""
    from pyspark.sql import Window

    c = ctx(spark, sf_dir)
    neigh = LR.knn_neighbours(c.feats, c.folds)
    w = Window.partitionBy("qid").orderBy("d2", "tid")
    return neigh.select("qid", "tid", F.row_number().over(w).alias("rank"), _r("d2"))


@query(
    "baseline_votes",
    cv_sql("SELECT id, fold, learner, CAST(vote AS INTEGER) AS vote, CAST(y AS INTEGER) AS y FROM base"),
)
def baseline_votes(spark, sf_dir):
    """Always pos, always neg, random."""
    return E.baseline_votes(ctx(spark, sf_dir).tests, SEED)


@query(
    "ensemble_votes",
    cv_sql("SELECT id, fold, learner, CAST(vote AS INTEGER) AS vote, CAST(y AS INTEGER) AS y FROM ens"),
)
def ensemble_votes(spark, sf_dir):
    """G17 + X18 over naive Bayes, weighted naive Bayes and kNN."""
    votes = ctx(spark, sf_dir).o_votes()
    return votes.where(F.col("learner").startswith("ensemble_"))


_METRIC_COLS = (
    "fold, learner, CAST(cls AS INTEGER) AS cls, round(precision, 6) AS precision, round(recall, 6) AS recall, "
    "support, round(no_decision, 6) AS no_decision, supposed, round(gain, 6) AS gain, "
    "round(gain_per_supposition, 6) AS gain_per_supposition, round(precision_total, 6) AS precision_total"
)


def _metrics(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return E.fold_metrics(c.o_votes(), c.folds)


@query("cv_metrics", cv_sql(f"SELECT {_METRIC_COLS} FROM metrics"))
def cv_metrics(spark, sf_dir):
    """G9-G12 + G10 per fold, learner and class (voters, ensembles, baselines)."""
    m = _metrics(spark, sf_dir)
    return m.select(
        "fold", "learner", "cls", _r("precision"), _r("recall"), "support", _r("no_decision"), "supposed", _r("gain"),
        _r("gain_per_supposition"), _r("precision_total"),
    )


@query(
    "cv_gain",
    cv_sql(
        "SELECT fold, learner, CAST(cls AS INTEGER) AS cls, round(gain, 6) AS gain, supposed, "
        "round(gain_per_supposition, 6) AS gain_per_supposition FROM metrics WHERE cls <> 0"
    ),
)
def cv_gain(spark, sf_dir):
    """Net gain of pos and neg calls and gain per supposition."""
    m = _metrics(spark, sf_dir).where(F.col("cls") != 0)
    return m.select("fold", "learner", "cls", _r("gain"), "supposed", _r("gain_per_supposition"))


@query(
    "confusion_matrix",
    cv_sql(
        "SELECT learner, CAST(y AS INTEGER) AS y, count(*) FILTER (WHERE vote = 1) AS pos, "
        "count(*) FILTER (WHERE vote = -1) AS neg FROM votes GROUP BY learner, y"
    ),
)
def confusion_matrix(spark, sf_dir):
    """Summed over folds, no-decision left out."""
    return E.confusion_matrix(ctx(spark, sf_dir).o_votes())


_SUMMARY_SQL = (
    "WITH long AS ("
    + " UNION ALL ".join(
        f"SELECT fold, learner, CAST(cls AS INTEGER) AS cls, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM metrics WHERE cls <> 0"
        for m in E.SUMMARY_METRICS
    )
    + " UNION ALL SELECT fold, learner, 0, 'precision_total', precision_total FROM metrics WHERE cls = 1)"
    + " SELECT learner, metric, cls, round(avg(value), 6) AS mean, round(stddev_pop(value) / 2, 6) AS half_std"
    + " FROM long GROUP BY learner, metric, cls"
)


@query("cv_summary", S.with_ctes(*_cv_ctes()).rstrip() + ",\n" + _SUMMARY_SQL[len("WITH "):])
def cv_summary(spark, sf_dir):
    """Mean and half the population std over folds (nulls left out)."""
    s = E.cv_summary(_metrics(spark, sf_dir))
    return s.select("learner", "metric", "cls", _r("mean"), _r("half_std"))


# ------------------------------------------------- rows-only: ML voters
def _vectors(c: CVContext):
    key = "vectors"
    if key not in c._votes:
        c._votes[key] = reliable_checkpoint(c.tm.vectors(c.sel))
    return c._votes[key]


def _ml_votes(c: CVContext, name: str, weighted: bool = False):
    key = ("ml", name, weighted)
    if key not in c._votes:
        w = "error_cost" if weighted else None
        if name == "svm_linear":
            v = LR.ml_fold_votes(LR.MLVoter("svm_linear", True), _vectors(c), c.folds, c.tm.size, weight_col=w)
        elif name == "svm_rff":
            z = reliable_checkpoint(LR.rff_long(c.feats, c.tm.size, c.folds))
            coef = SGD.fit(z, c.folds, LR.RFF_COMPONENTS, w, nu=SGD.NU)
            v = reliable_checkpoint(SGD.votes(SGD.scores(z, c.tests, coef, LR.RFF_COMPONENTS), "svm_rff"))
        elif name == "sgd_linear":
            v = reliable_checkpoint(SGD.votes(SGD.scores(c.feats, c.tests, SGD.fit(c.feats, c.folds, c.tm.size, w), c.tm.size)))
        elif name == "boosting":
            v = LR.ml_fold_votes(LR.MLVoter("boosting", False), _vectors(c), c.folds, c.tm.size)
        else:
            raise ValueError(name)
        c._votes[key] = v
    return c._votes[key]


@query("svm_linear")
def svm_linear(spark, sf_dir):
    """M5: linear SVM votes per fold (pyspark.ml LinearSVC)."""
    return _ml_votes(ctx(spark, sf_dir), "svm_linear")


@query("svm_weighted")
def svm_weighted(spark, sf_dir):
    """M5 + M11: linear SVM with error cost as sample weight."""
    return _ml_votes(ctx(spark, sf_dir), "svm_linear", weighted=True).withColumn("learner", F.lit("svm_weighted"))


@query("svm_rff")
def svm_rff(spark, sf_dir):
    """M6: nu-SVM with the RBF kernel, its primal solved on random Fourier features."""
    return _ml_votes(ctx(spark, sf_dir), "svm_rff")


@query("sgd_linear")
def sgd_linear(spark, sf_dir):
    """M8: hinge-loss linear model by stochastic gradient."""
    return _ml_votes(ctx(spark, sf_dir), "sgd_linear")


@query("boosting")
def boosting(spark, sf_dir):
    """Gradient-boosted trees per fold."""
    return _ml_votes(ctx(spark, sf_dir), "boosting")


@query("cv_metrics_all")
def cv_metrics_all(spark, sf_dir):
    """M12 as the reference runs it: six voters, three ensembles over them,
    three baselines, one metric aggregation."""
    c = ctx(spark, sf_dir)
    nb = LR.naive_bayes_votes(c.nb_scores(False), "naive_bayes")
    voters = nb.unionByName(c.knn())
    for name in ("svm_linear", "svm_rff", "sgd_linear", "boosting"):
        voters = voters.unionByName(_ml_votes(c, name))
    ens = E.ensemble_votes(voters, ALL_VOTERS)
    votes = voters.unionByName(ens).unionByName(E.baseline_votes(c.tests, SEED))
    return E.fold_metrics(votes, c.folds)


@query("svm_reduced")
def svm_reduced(spark, sf_dir):
    """M3 + M4 + M5: the dense branch - 100 whitened components of the whole
    dictionary, a scaler fitted per training fold, linear SVM."""
    c = ctx(spark, sf_dir)
    tm = fit_transformation(c.sel, CV_OPTS.replace(reduction=True))
    dense = reliable_checkpoint(tm.vectors(c.sel))
    return LR.ml_fold_votes(LR.MLVoter("svm_linear", True), dense, c.folds, tm.n_features, scale=True).withColumn(
        "learner", F.lit("svm_reduced")
    )
