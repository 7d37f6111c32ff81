"""The reduction against a dense decomposition, on both block layouts, through a saved transformation."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row

from wordtally.operators import reduction as R
from wordtally.operators.vectorize import assemble, fit_transformation, load_transformation, save_transformation
from wordtally.options import TransformOptions


def long_of(spark, x):
    i, j = np.nonzero(x)
    return spark.createDataFrame(pd.DataFrame({"id": i, "idx": j.astype("int32"), "value": x[i, j]}), "id long, idx int, value double")


def matrix(n=120, m=2300, rank=5):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, rank)) * [40, 30, 20, 10, 5] @ rng.standard_normal((rank, m))
    x[:, rng.random(m) < 0.8] = 0.0  # words outside every direction
    return x + 3.0 * (rng.random((n, m)) < 0.01)


@pytest.mark.parametrize("block", [65_536, 1024])
def test_axes_match_a_dense_decomposition(spark, block):
    x = matrix()
    n = len(x)
    ids = spark.range(n)
    red = R.fit(long_of(spark, x), ids, x.shape[1], 4, block=block)
    z = np.array([r.reduced for r in R.project(red, long_of(spark, x), ids, block=block).orderBy("id").collect()])
    assert np.abs(z.mean(axis=0)).max() < 1e-9
    assert np.abs(z.T @ z / n - np.eye(4)).max() < 1e-9
    xc = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(xc, full_matrices=False)
    want = u[:, :4] * np.sqrt(n)
    assert np.abs(np.abs(z.T @ want / n) - np.eye(4)).max() < 1e-4  # up to sign
    new = np.zeros((2, x.shape[1]))
    new[0, :7] = 2.0
    axes = red.axes.orderBy("idx").collect()
    got = np.array([r.reduced for r in R.project(red, long_of(spark, new), spark.range(2), block=block).orderBy("id").collect()])
    assert np.abs(got - (new - [r["mean"] for r in axes]) @ np.array([r.axis for r in axes])).max() < 1e-9


def test_fewer_directions_than_components(spark):
    x = np.zeros((6, 4))
    x[:, 0] = [1, 2, 3, 4, 5, 6]
    x[:, 1] = 2 * x[:, 0]
    red = R.fit(long_of(spark, x), spark.range(6), 4, 100)
    z = np.array([r.reduced for r in R.project(red, long_of(spark, x), spark.range(6)).orderBy("id").collect()])
    assert z.shape == (6, 4) and abs(z[:, 0].std() - 1) < 1e-9 and np.abs(z[:, 1:]).max() == 0.0


def test_nothing_to_reduce(spark):
    empty = spark.createDataFrame([], "id long, idx int, value double")
    red = R.fit(empty, spark.range(3), 5, 2)
    assert [r.reduced for r in R.project(red, empty, spark.range(3)).collect()] == [[0.0, 0.0]] * 3


def docs(spark):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(40)]
    return spark.createDataFrame(
        [Row(id=i, class_label="pos" if i % 2 else "neg", words=[words[j] for j in rng.integers(0, 20 + 20 * (i % 2), 15)]) for i in range(50)]
    )


def test_option_is_honoured_saved_and_loaded(spark, tmpdir_path):
    sel = docs(spark)
    tm = fit_transformation(sel, TransformOptions(min_tokens=1, reduction=True, components=3))
    assert tm.n_features == 3
    vec = tm.vectors(sel).collect()
    assert len(vec) == 50 and all(r.features.size == 3 for r in vec)
    path = os.path.join(tmpdir_path, "tm")
    save_transformation(tm, path)
    again = load_transformation(spark, path)
    new = spark.createDataFrame([Row(id=900, words=["word1", "word30"]), Row(id=901, words=["unknown"])])

    def values(t):
        return sorted((r.id, r.idx, round(r.value, 9)) for r in t.features(new).collect())

    assert values(tm) == values(again) and len(values(tm)) == 6


def test_stored_sparse_vectors(spark):
    long = spark.createDataFrame([(1, 2, 0.5), (1, 0, 2.0), (5, 4, 1.0)], "id long, idx int, value double")
    got = {r.id: r.features for r in assemble(long, 6, spark.createDataFrame([(1,), (5,), (9,)], "id long")).collect()}
    assert got[1].size == 6 and dict(zip(got[1].indices.tolist(), got[1].values.tolist())) == {0: 2.0, 2: 0.5}
    assert got[5].toArray().tolist() == [0, 0, 0, 0, 1, 0] and got[9].numNonzeros() == 0


def test_a_chunk_gets_only_the_features_it_holds(spark):
    """What the products ship follows the entries, not chunks x features."""
    n, m, width = 40, 5 * R.TILE, 3
    long = spark.createDataFrame([(i, i * (m // n), 1.0) for i in range(n)] + [(i, 7, 2.0) for i in range(n)], "id long, idx int, value double")
    parts = R.cells(long, spark.range(n))
    tiles = spark.createDataFrame([(t, np.arange(t * R.TILE * width, (t + 1) * R.TILE * width, dtype=float).tobytes()) for t in range(5)], "tile long, data binary")
    sent = R._with_tiles(parts, tiles, width).where("tile >= 0").collect()
    assert sum(len(r["data"]) for r in sent) == (n + 1) * width * 8
    x, q = np.zeros((n, m)), np.arange(m * width, dtype=float).reshape(m, width)
    x[np.arange(n), np.arange(n) * (m // n)] = 1.0
    x[:, 7] += 2.0
    for block in (1, 16, R.BLOCK):
        got = np.zeros((m, width))
        for r in R.crossed(parts, tiles, width, block).collect():
            got[r["tile"] * R.TILE : (r["tile"] + 1) * R.TILE] = np.frombuffer(r["data"]).reshape(R.TILE, width)
        assert np.allclose(got, x.T @ (x @ q), rtol=1e-12)


def test_moments_pair_the_rows_of_an_id(spark):
    """F16: the sums over pairs of components, as a join of the components on the id gives them."""
    rows = [(1, [1.0, 2.0, -1.0]), (1, [0.5, 0.0, 4.0]), (2, [3.0, -2.0, 1.0]), (None, [9.0, 9.0, 9.0])]
    z = spark.createDataFrame(rows, "id long, reduced array<double>").repartition(3)
    found = R.moments(z)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    pairs = [(np.array(x), np.array(y)) for i, x in rows for j, y in rows if i is not None and i == j]
    mx, my = np.mean([x for x, _ in pairs], axis=0), np.mean([y for _, y in pairs], axis=0)
    for r in found.collect():
        assert abs(r["mean"] - mx[r["a"]]) < 1e-12
        assert abs(r["covariance"] - (np.mean([x[r["a"]] * y[r["b"]] for x, y in pairs]) - mx[r["a"]] * my[r["b"]])) < 1e-12
    assert found.count() == 6


def test_fit_leaves_its_axes_only(spark):
    from wordtally.session import ensure_checkpoint_dir

    folder = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "tables", spark.sparkContext.applicationId)
    rows = [(i, j, float((i * 7 + j * 3) % 5 + 1)) for i in range(30) for j in range(6) if (i + j) % 3]
    long = spark.createDataFrame(rows, "id long, idx int, value double")
    ids = spark.range(31)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    red = R.fit(long, ids, 6, 3)
    left = set(os.listdir(folder)) - before
    assert {f.split("/")[-2] for f in red.axes.inputFiles()} == left and len(left) == 1
    assert red.axes.count() == 6 and R.project(red, long, ids).count() == 31
