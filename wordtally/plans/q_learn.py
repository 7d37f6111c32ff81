"""Scaling and reduction queries: M4, M3."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordtally.operators import learners as LR
from wordtally.operators import reduction as R
from wordtally.operators.vectorize import fit_transformation
from wordtally.options import TransformOptions
from wordtally.plans import query
from wordtally.plans import sql as S
from wordtally.plans.q_vectorize import bag_ctes
from wordtally.sources.tables import labelled_selection, read_table


@query(
    "scale",
    """WITH l AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
                  CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
s AS (SELECT dim, avg(value) AS mu, stddev_pop(value) AS sd FROM l GROUP BY dim)
SELECT l.vec_id, l.dim, round((l.value - s.mu) / CASE WHEN s.sd = 0 THEN 1.0 ELSE s.sd END, 6) AS value
FROM l JOIN s ON s.dim = l.dim""",
)
def scale(spark, sf_dir):
    """M4: dense rows (embeddings) to zero mean and unit population std per dimension."""
    emb = read_table(spark, sf_dir, "embeddings")
    long = emb.select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.col("value").cast("double")
    )
    out = LR.standard_scale(long, key="vec_id")
    return out.select("vec_id", "dim", F.round("value", 6).alias("value"))


REDUCE_OPTS = TransformOptions(reduction=True)


def _reduced(spark, sf_dir):
    sel = labelled_selection(spark, sf_dir)
    return fit_transformation(sel, REDUCE_OPTS), sel


@query("reduce")
def reduce(spark, sf_dir):
    """M3: whitened principal components (100) of the tf-idf rows over the whole dictionary."""
    tm, sel = _reduced(spark, sf_dir)
    return tm.features(sel).select("id", F.col("idx").alias("component"), "value")


@query(
    "reduce_moments",
    S.with_ctes(*bag_ctes(REDUCE_OPTS), f"k AS (SELECT least((SELECT count(*) FROM sel), (SELECT count(*) FROM dict), {REDUCE_OPTS.components}) AS k)")
    + """SELECT CAST(a.range AS INTEGER) AS a, CAST(b.range AS INTEGER) AS b, 0.0::DOUBLE AS mean, CASE WHEN a.range = b.range THEN 1.0 ELSE 0.0 END::DOUBLE AS covariance
FROM k, range(k) a, range(k) b WHERE a.range <= b.range""",
)
def reduce_moments(spark, sf_dir):
    """M3: every component has mean 0 and variance 1, every two have correlation 0."""
    tm, sel = _reduced(spark, sf_dir)
    pair = R.moments(tm.reduced(sel))
    zero = F.lit(0.0)  # rounding may leave a minus sign
    return pair.select("a", "b", (F.round("mean", 6) + zero).alias("mean"), (F.round("covariance", 6) + zero).alias("covariance"))
