"""Cross-validation as DataFrame work.

training set (S8: J3 label/gain/cost lookup, J4 dictionary mark, F9 +1/-1)
-> stratified fold (W4: round robin by id inside each class, via the
distributed dense index) -> votes of every learner in long form
``(id, fold, learner, vote, y)`` -> baselines (X19) and ensembles (G17, X18)
-> one aggregation for all metrics (G9-G15) -> fold summary (G16).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtally.functions.hashing import random_vote
from wordtally.operators.ranking import dense_index

N_FOLDS = 10
CLASSES = (1, 0, -1)


def training_set(samples: DataFrame, table: DataFrame, dictionary_ids: DataFrame) -> DataFrame:
    """``samples(id)`` -> ``id, y, success_gain, error_cost, in_dictionary``.

    J3 looks up label, gain and cost by id (equi join; the reference's point
    lookup per id, F14, done for all ids at once); J4 marks the ids that
    built the dictionary (left join on the id list, flag when matched); F9
    maps ``pos`` -> +1 and anything else -> -1.
    """
    looked = samples.select("id").join(table.select("id", "class_label", "success_gain", "error_cost"), "id")
    marks = dictionary_ids.select("id", F.lit(True).alias("_m"))
    return looked.join(marks, "id", "left").select(
        "id",
        F.when(F.col("class_label") == "pos", 1).otherwise(-1).cast("int").alias("y"),
        "success_gain",
        "error_cost",
        F.coalesce("_m", F.lit(False)).alias("in_dictionary"),
    )


def assign_folds(ts: DataFrame, n_folds: int = N_FOLDS) -> DataFrame:
    """fold = (rank of id inside its class) mod n_folds; fold sizes of a
    class differ by at most one. Ranked without a per-class single task."""
    ranked = dense_index(ts, [F.col("id").asc()], group="y", idx_col="_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank"), F.lit(n_folds)).cast("int")).drop("_rank")


def test_rows(folds: DataFrame, exclude_dictionary_docs: bool = True) -> DataFrame:
    """The rows scored in their own fold."""
    return folds.where(~F.col("in_dictionary")) if exclude_dictionary_docs else folds


def baseline_votes(tests: DataFrame, seed: str = "0") -> DataFrame:
    """Always pos, always neg, and a repeatable random vote."""
    base = tests.select("id", "fold", "y")
    return (
        base.select("id", "fold", F.lit("always_pos").alias("learner"), F.lit(1).alias("vote"), "y")
        .unionByName(base.select("id", "fold", F.lit("always_neg").alias("learner"), F.lit(-1).alias("vote"), "y"))
        .unionByName(
            base.select("id", "fold", F.lit("random").alias("learner"), random_vote(F.col("id"), seed).alias("vote"), "y")
        )
    )


def ensemble_rule(total: Column, n_voters: int | Column) -> tuple[Column, Column, Column]:
    """Majority sign(sum); all but one |sum| >= n-2; all |sum| = n
    (the reference's > 3 and = 6 for six voters); otherwise 0 = no decision."""
    d = F.when(total > 0, 1).otherwise(-1)
    major = F.when(F.abs(total) > 0, d).otherwise(0)
    n = F.lit(n_voters) if isinstance(n_voters, int) else n_voters
    but_one = F.when(F.abs(total) >= F.greatest(n - 2, F.lit(1)), d).otherwise(0)
    every = F.when(F.abs(total) == n, d).otherwise(0)
    return major.cast("int"), but_one.cast("int"), every.cast("int")


def ensemble_votes(votes: DataFrame, voters: list[str]) -> DataFrame:
    """G17 + X18 over the named voters' rows of ``votes``."""
    agg = (
        votes.where(F.col("learner").isin(voters))
        .groupBy("id", "fold", "y")
        .agg(F.sum("vote").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    )
    major, but_one, every = ensemble_rule(F.col("_sum"), len(voters))
    return agg.select(
        "id",
        "fold",
        "y",
        F.explode(
            F.array(
                F.struct(F.lit("ensemble_majority").alias("learner"), major.alias("vote")),
                F.struct(F.lit("ensemble_all_but_one").alias("learner"), but_one.alias("vote")),
                F.struct(F.lit("ensemble_all").alias("learner"), every.alias("vote")),
            )
        ).alias("e"),
    ).select("id", "fold", "e.learner", "e.vote", "y")


def fold_metrics(votes: DataFrame, folds: DataFrame) -> DataFrame:
    """G9-G14 (G11: no-decision rate per true class) in one aggregation per
    (fold, learner), then one row per class.

    ``fold, learner, cls, precision, recall, support, no_decision, supposed,
    gain, gain_per_supposition, precision_total``. Precision with no
    prediction is 0; a rate over an empty class is null (Q11).
    """
    v = votes.join(folds.select("id", "success_gain", "error_cost"), "id")
    vote, y, g, c = F.col("vote"), F.col("y"), F.col("success_gain"), F.col("error_cost")

    def cnt(cond: Column) -> Column:
        return F.count_if(cond).cast("long")

    aggs = []
    for k in CLASSES:
        tag = {1: "p", 0: "z", -1: "n"}[k]
        aggs += [
            cnt(y == k).alias(f"s_{tag}"),
            cnt(vote == k).alias(f"t_{tag}"),
            cnt((vote == k) & (y == k)).alias(f"h_{tag}"),
            cnt((vote == 0) & (y == k)).alias(f"nd_{tag}"),
        ]
    aggs += [
        F.sum(F.when((vote == 1) & (y == 1), g).when((vote == 1) & (y == -1), -c).otherwise(0.0)).alias("g_p"),
        F.sum(F.when((vote == -1) & (y == -1), g).when((vote == -1) & (y == 1), -c).otherwise(0.0)).alias("g_n"),
    ]
    m = v.groupBy("fold", "learner").agg(*aggs)

    def prec(tag):
        return F.when(F.col(f"t_{tag}") > 0, F.col(f"h_{tag}") / F.col(f"t_{tag}")).otherwise(0.0)

    def rec(tag):
        return F.when(F.col(f"s_{tag}") > 0, F.col(f"h_{tag}") / F.col(f"s_{tag}")).otherwise(0.0)

    ptotal = F.try_divide(prec("p") * F.col("s_p") + prec("n") * F.col("s_n"), (F.col("s_p") + F.col("s_n")).cast("double"))
    rows = []
    for k in CLASSES:
        tag = {1: "p", 0: "z", -1: "n"}[k]
        nd = F.lit(0.0) if k == 0 else F.try_divide(F.col(f"nd_{tag}").cast("double"), F.col(f"s_{tag}").cast("double"))
        gain = F.lit(0.0) if k == 0 else F.col(f"g_{tag}")
        rows.append(
            F.struct(
                F.lit(k).alias("cls"),
                prec(tag).alias("precision"),
                rec(tag).alias("recall"),
                F.col(f"s_{tag}").alias("support"),
                nd.alias("no_decision"),
                F.col(f"t_{tag}").alias("supposed"),
                gain.alias("gain"),
                F.try_divide(gain, F.col(f"t_{tag}").cast("double")).alias("gain_per_supposition"),
            )
        )
    return m.select("fold", "learner", ptotal.alias("precision_total"), F.explode(F.array(*rows)).alias("r")).select(
        "fold",
        "learner",
        F.col("r.cls").cast("int").alias("cls"),
        "r.precision",
        "r.recall",
        "r.support",
        "r.no_decision",
        "r.supposed",
        "r.gain",
        "r.gain_per_supposition",
        "precision_total",
    )


def confusion_matrix(votes: DataFrame) -> DataFrame:
    """``learner, y, pos, neg`` summed over folds; no-decision left out."""
    return (
        votes.groupBy("learner", "y")
        .agg(F.count_if(F.col("vote") == 1).cast("long").alias("pos"), F.count_if(F.col("vote") == -1).cast("long").alias("neg"))
    )


SUMMARY_METRICS = ("precision", "recall", "support", "supposed", "no_decision", "gain", "gain_per_supposition")


def cv_summary(metrics: DataFrame) -> DataFrame:
    """Mean and half the population std over folds, per learner, metric
    and class (pos and neg), plus the total precision; nulls are left out."""
    long = metrics.where(F.col("cls") != 0).select(
        "fold",
        "learner",
        "cls",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in SUMMARY_METRICS])
        ).alias("m"),
    ).select("fold", "learner", "cls", "m.metric", "m.value")
    total = metrics.where(F.col("cls") == 1).select(
        "fold", "learner", F.lit(0).alias("cls"), F.lit("precision_total").alias("metric"), F.col("precision_total").alias("value")
    )
    return (
        long.unionByName(total)
        .groupBy("learner", "metric", "cls")
        .agg(F.avg("value").alias("mean"), (F.stddev_pop("value") / 2).alias("half_std"))
    )


def format_summary(summary: DataFrame) -> DataFrame:
    """``mean (+/- half_std)`` as text, percent for rates."""
    pct = F.col("metric").isin("precision", "recall", "no_decision", "precision_total")
    scale = F.when(pct, F.lit(100.0)).otherwise(F.lit(1.0))
    text = F.format_string("%6.2f (+/- %5.2f)", F.col("mean") * scale, F.col("half_std") * scale)
    return summary.withColumn("text", F.when(pct, F.concat(text, F.lit("%"))).otherwise(text))


def vote_label(vote: Column) -> Column:
    """Pos / neg / N/D."""
    return F.when(vote > 0, "pos").when(vote < 0, "neg").otherwise("N/D")
