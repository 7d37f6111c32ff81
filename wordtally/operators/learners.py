"""The six voters, fitted and scored for all folds.

* ``naive_bayes_votes`` (M9, M11): Bernoulli naive Bayes as aggregations and
  joins. Training counts of fold f are the totals minus the counts of fold f,
  so all ten folds come from one pass. Smoothing alpha = 1, unsmoothed class
  prior (as in the reference's library, Q10), ties go to -1.
* ``knn_votes`` (M7, J11, W7): exact k nearest neighbours (k = 11, squared distances compared at 6 decimals, weights
  1/distance; with a zero distance only the exact matches vote). Documents
  are hashed into blocks, each stored once as a row of arrays; a nested-loop
  join of the two block tables, which shuffles no block twice, brings every
  (query block, train block) pair to a task that computes the block's
  distances with numpy and keeps the k best per query over all the train
  blocks it meets; a windowed top-k merges the tasks. Memory per task is
  bounded by the block sizes; no pair is ever emitted as a row.
* pyspark.ml voters (M5, M10 on few rows) fitted per fold by full-batch solvers, which
  do not depend on row order; the stochastic gradients (M8, M6, W8) are in ``sgd.py``,
  the boosted trees of more rows (M10) in ``boosting.py``, the linear SVM of many features (M5) in ``svm.py``.
* ``standard_scale`` (M4); the reduction (M3) is in ``reduction.py``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordtally.operators import boosting as BT
from wordtally.operators import svm as SVM
from wordtally.operators.joins import checked_broadcast
from wordtally.operators.reduction import sparse_rows
from wordtally.session import reliable_checkpoint

VOTE_COLUMNS = ["id", "fold", "learner", "vote", "y"]


# --------------------------------------------------------------- naive Bayes
def naive_bayes_scores(
    presence: DataFrame,
    folds: DataFrame,
    dict_size: int,
    weight_col: str | None = None,
    alpha: float = 1.0,
    exclude_dictionary_docs: bool = True,
    n_folds: int = 10,
) -> DataFrame:
    """``id, fold, y, jll_pos, jll_neg`` for every test document (one weighting)."""
    multi = naive_bayes_scores_multi(
        presence, folds, dict_size, {"nb": weight_col}, alpha, exclude_dictionary_docs, n_folds
    )
    return multi.drop("learner")


def naive_bayes_scores_multi(
    presence: DataFrame,
    folds: DataFrame,
    dict_size: int,
    weightings: dict[str, str | None],
    alpha: float = 1.0,
    exclude_dictionary_docs: bool = True,
    n_folds: int = 10,
) -> DataFrame:
    """``id, fold, y, learner, jll_pos, jll_neg`` for every test document and
    every weighting (learner name -> weight column or None), all fitted by
    the same aggregations.

    ``presence(id, idx)`` lists the present features (binarized at 0),
    ``folds(id, y, fold, in_dictionary[, weight columns])``. Training counts of
    fold f are totals minus fold f.
    """
    spark = folds.sparkSession
    names = list(weightings)
    ks = range(len(names))
    docs = folds.select(
        "id", "y", "fold", "in_dictionary",
        *[(F.col(w).cast("double") if w else F.lit(1.0)).alias(f"w{k}") for k, w in zip(ks, weightings.values())],
    )

    # class weight per (fold, class) and per class: 2 x n_folds rows
    cls_fold = docs.groupBy("fold", "y").agg(*[F.sum(f"w{k}").alias(f"cwf{k}") for k in ks])
    cls_tot = docs.groupBy("y").agg(*[F.sum(f"w{k}").alias(f"cwt{k}") for k in ks])
    fold_class = [(f, y) for f in range(n_folds) for y in (1, -1)]
    grid_fc = spark.createDataFrame(fold_class, "fold int, y int")
    cls = grid_fc.join(F.broadcast(cls_tot), "y", "left").join(F.broadcast(cls_fold), ["fold", "y"], "left").select(
        "fold", "y", *[(F.coalesce(f"cwt{k}", F.lit(0.0)) - F.coalesce(f"cwf{k}", F.lit(0.0))).alias(f"cw{k}") for k in ks]
    )
    per_fold = Window.partitionBy("fold")
    cls = cls.select("fold", "y", *[F.col(f"cw{k}") for k in ks],
                     *[F.log(F.col(f"cw{k}") / F.sum(f"cw{k}").over(per_fold)).alias(f"prior{k}") for k in ks])

    # feature weight per (fold, class, idx), bounded by folds x 2 x dictionary
    feat_fold = reliable_checkpoint(
        presence.join(docs, "id").groupBy("fold", "y", "idx").agg(*[F.sum(f"w{k}").alias(f"fwf{k}") for k in ks])
    )
    feat_tot = feat_fold.groupBy("y", "idx").agg(*[F.sum(f"fwf{k}").alias(f"fwt{k}") for k in ks])
    # every (fold, class, index): dictionary x 2 x n_folds rows, generated, not joined
    grid = spark.range(dict_size).select(
        F.col("id").cast("int").alias("idx"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(y).alias("y")) for f, y in fold_class])).alias("g"),
    ).select("idx", "g.fold", "g.y")
    joined = grid.join(feat_tot, ["y", "idx"], "left").join(feat_fold, ["fold", "y", "idx"], "left").join(
        F.broadcast(cls), ["fold", "y"]
    )
    p = {
        k: (F.coalesce(f"fwt{k}", F.lit(0.0)) - F.coalesce(f"fwf{k}", F.lit(0.0)) + alpha) / (F.col(f"cw{k}") + 2 * alpha)
        for k in ks
    }
    # the fitted model of every fold and weighting, read twice below
    stats = reliable_checkpoint(
        joined.select(
            "fold", "y", "idx",
            *[F.col(f"prior{k}") for k in ks],
            *[F.log(1 - p[k]).alias(f"l1p{k}") for k in ks],
            *[(F.log(p[k]) - F.log(1 - p[k])).alias(f"delta{k}") for k in ks],
        )
    )
    base = stats.groupBy("fold", "y").agg(*[(F.first(f"prior{k}") + F.sum(f"l1p{k}")).alias(f"base{k}") for k in ks])
    delta = stats.select("fold", "y", "idx", *[f"delta{k}" for k in ks])

    tests = docs.where(~F.col("in_dictionary")) if exclude_dictionary_docs else docs
    tests = tests.select("id", "fold", F.col("y").alias("true_y"))
    present = presence.join(tests.select("id", "fold"), "id")
    per_doc = present.join(checked_broadcast(delta, 2 * n_folds * dict_size), ["fold", "idx"]).groupBy("id", "y").agg(
        *[F.sum(f"delta{k}").alias(f"ds{k}") for k in ks]
    )
    scored = tests.join(F.broadcast(base), "fold").join(per_doc, ["id", "y"], "left").select(
        "id", "fold", "true_y", "y", *[(F.col(f"base{k}") + F.coalesce(f"ds{k}", F.lit(0.0))).alias(f"jll{k}") for k in ks]
    )
    wide = scored.groupBy("id", "fold", F.col("true_y").alias("y")).agg(
        *[F.max(F.when(F.col("y") == 1, F.col(f"jll{k}"))).alias(f"pos{k}") for k in ks],
        *[F.max(F.when(F.col("y") == -1, F.col(f"jll{k}"))).alias(f"neg{k}") for k in ks],
    )
    per_learner = F.explode(
        F.array(*[F.struct(F.lit(n).alias("learner"), F.col(f"pos{k}").alias("jll_pos"), F.col(f"neg{k}").alias("jll_neg"))
                  for k, n in zip(ks, names)])
    )
    return wide.select("id", "fold", "y", per_learner.alias("s")).select("id", "fold", "y", "s.learner", "s.jll_pos", "s.jll_neg")


def naive_bayes_votes(scores: DataFrame, learner: str = "naive_bayes", digits: int = 5) -> DataFrame:
    """Vote +1 when the pos score is larger (compared at ``digits`` decimals), else -1."""
    vote = F.when(F.round("jll_pos", digits) > F.round("jll_neg", digits), 1).otherwise(-1).cast("int")
    return scores.select("id", "fold", F.lit(learner).alias("learner"), vote.alias("vote"), "y")


def fit_naive_bayes(presence: DataFrame, train: DataFrame, size: int, weightings: dict[str, str | None], alpha: float = 1.0) -> DataFrame:
    """``idx`` and, for each name, ``<name>_pos`` and ``<name>_neg``: what a present feature adds to the class's log
    likelihood. The row of index -1 holds what a document without features has. ``train(id, y[, weight columns])``."""
    names = list(weightings)
    w = {n: F.col(c).cast("double") if c else F.lit(1.0) for n, c in weightings.items()}
    docs = train.select("id", "y", *[w[n].alias(f"w_{n}") for n in names])

    def by_class(n: str, y: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("y") == y, F.col(f"w_{n}"))), F.lit(0.0))

    sides = [(n, tag, y) for n in names for tag, y in (("pos", 1), ("neg", -1))]
    total = docs.agg(*[by_class(n, y).alias(f"{n}_{tag}") for n, tag, y in sides]).first()
    seen = presence.join(docs, "id").groupBy("idx").agg(*[by_class(n, y).alias(f"f_{n}_{tag}") for n, tag, y in sides])
    every = train.sparkSession.range(size).select(F.col("id").cast("int").alias("idx")).join(seen, "idx", "left")

    def p(n: str, tag: str) -> Column:
        return (F.coalesce(f"f_{n}_{tag}", F.lit(0.0)) + alpha) / (total[f"{n}_{tag}"] + 2 * alpha)

    fitted = reliable_checkpoint(every.select(
        "idx",
        *[(F.log(p(n, tag)) - F.log(1 - p(n, tag))).alias(f"{n}_{tag}") for n, tag, _ in sides],
        *[F.log(1 - p(n, tag)).alias(f"l_{n}_{tag}") for n, tag, _ in sides],
    ))

    def prior(n: str, tag: str) -> float:
        both = total[f"{n}_pos"] + total[f"{n}_neg"]
        return math.log(total[f"{n}_{tag}"] / both) if total[f"{n}_{tag}"] > 0 else -math.inf

    base = fitted.agg(*[(F.coalesce(F.sum(f"l_{n}_{tag}"), F.lit(0.0)) + F.lit(prior(n, tag))).alias(f"{n}_{tag}") for n, tag, _ in sides])
    columns = [f"{n}_{tag}" for n, tag, _ in sides]
    return fitted.select("idx", *columns).unionByName(base.select(F.lit(-1).alias("idx"), *columns))


# ----------------------------------------------------------------------- kNN
_CAND_SCHEMA = "space string, qid long, qfold int, qy int, tid long, ty int, d2 double"


def _flatten(ix_lists, vx_lists):
    lens = np.fromiter((len(a) for a in ix_lists), dtype=np.int64, count=len(ix_lists))
    ix = np.concatenate([np.asarray(a, dtype=np.int64) for a in ix_lists]) if lens.sum() else np.zeros(0, np.int64)
    vx = np.concatenate([np.asarray(a, dtype=np.float64) for a in vx_lists]) if lens.sum() else np.zeros(0)
    return lens, ix, vx


#: Share of a query block's rows from which a column is frequent, and frequent columns at most (those of most rows).
HEAVY_SHARE, MAX_HEAVY = 0.08, 4096
#: Training rows multiplied at once, and (query entry, training entry) pairs.
STRIP_ROWS, STRIP_PAIRS = 256, 1 << 17


class _Columns:
    """A query block by its columns: frequent ones dense, each other one as a run of entries.

    Columns held by many queries (frequent words) go through one dense BLAS
    product; the others through explicit (query entry, training entry) pairs
    accumulated with ``bincount``, so few at once that they stay in the cache."""

    def __init__(self, q: "_Block"):
        order = np.lexsort((q.rows, q.cols))
        self.n, self.rows, self.vals = q.n, q.rows[order], q.vals[order]
        cols, self.start, self.count = np.unique(q.cols[order], return_index=True, return_counts=True)
        self.place = np.full(int(cols.max(initial=-1)) + 1, -1, np.int32)  # of each column among those of the block
        self.place[cols] = np.arange(len(cols))
        heavy = np.nonzero(self.count >= max(16, HEAVY_SHARE * q.n))[0]
        if len(heavy) > MAX_HEAVY:
            heavy = np.sort(heavy[np.argsort(-self.count[heavy], kind="stable")[:MAX_HEAVY]])
        self.slot = np.full(len(cols), -1)
        self.slot[heavy] = np.arange(len(heavy))
        self.dense = np.zeros((len(heavy), q.n))
        slots = np.repeat(self.slot, self.count)
        self.dense[slots[slots >= 0], self.rows[slots >= 0]] = self.vals[slots >= 0]

    def dots(self, t: "_Block"):
        """Products with a training block in strips of its rows: first row, ``dots[training row, query]``.

        Training entries arrive sorted by row and column and pairs are cut at rows, so equal training rows
        accumulate in the same order."""
        at = np.nonzero(t.cols < len(self.place))[0]
        place = self.place[t.cols[at]]
        at, place = at[place >= 0], place[place >= 0]
        slot = self.slot[place]
        heavy, light = slot >= 0, slot < 0
        h_rows, h_slots, h_vals = t.rows[at[heavy]], slot[heavy], t.vals[at[heavy]]
        rows, vals, place = t.rows[at[light]], t.vals[at[light]], place[light]
        reps = self.count[place]
        pairs = np.concatenate([[0], np.cumsum(reps)])  # before each entry
        entry = np.searchsorted(rows, np.arange(t.n + 1))  # first entry of each row
        first = self.start[place] - pairs[:-1]  # a pair's place minus this is its query entry
        for top in range(0, t.n, STRIP_ROWS):
            end = min(top + STRIP_ROWS, t.n)
            own = slice(*np.searchsorted(h_rows, [top, end]))
            dense = np.zeros((end - top, len(self.dense)))
            dense[h_rows[own] - top, h_slots[own]] = h_vals[own]
            out = dense @ self.dense
            row = top
            while row < end:
                upto = min(max(row + 1, int(np.searchsorted(pairs[entry[row : end + 1]], pairs[entry[row]] + STRIP_PAIRS, side="right")) - 1 + row), end)
                a, last = entry[row], entry[upto]
                while a < last:  # one row alone may hold more pairs
                    b = min(max(a + 1, int(np.searchsorted(pairs[a : last + 1], pairs[a] + STRIP_PAIRS, side="right")) - 1 + a), last)
                    k = reps[a:b]
                    qi = np.arange(pairs[a], pairs[b]) + np.repeat(first[a:b], k)
                    flat = self.rows[qi] + np.repeat((rows[a:b] - row) * self.n, k)
                    weights = self.vals[qi] * np.repeat(vals[a:b], k)
                    size = (upto - row) * self.n
                    out[row - top : upto - top] += np.bincount(flat, weights=weights, minlength=size).reshape(-1, self.n)
                    a = b
                row = upto
            yield top, out


#: Blocks of training rows that a task of the search holds, and of query rows that it takes one after the other.
TRAIN_BLOCKS, QUERY_BLOCKS = 16, 8
_BLOCK_SCHEMA = "space string, block int, id array<long>, y array<int>, fold array<int>, lens binary, ix binary, vx binary"


def _pack_block(rows: pa.Table) -> pa.Table:
    """The rows of one block as one row: ids, classes, folds, and all entries one after the other."""
    rows = rows.combine_chunks()

    def bytes_of(values, dtype) -> pa.Array:
        return pa.array([np.ascontiguousarray(values.to_numpy(), dtype=dtype).tobytes()], pa.binary())

    ix, vx = rows["ix"], rows["vx"]
    lists = [pa.array([rows[c].to_pylist()], pa.list_(t)) for c, t in (("id", pa.int64()), ("y", pa.int32()), ("fold", pa.int32()))]
    return pa.Table.from_arrays(
        [rows["space"].slice(0, 1), rows["block"].slice(0, 1), *lists, bytes_of(pc.list_value_length(ix), np.int32),
         bytes_of(pc.list_flatten(ix), np.int32), bytes_of(pc.list_flatten(vx), np.float64)],
        names=["space", "block", "id", "y", "fold", "lens", "ix", "vx"],
    )


class _Block:
    """A block as arrays; ``rank`` orders its ids, null ones first."""

    def __init__(self, batch: pa.RecordBatch, at: int, side: str):
        cell = {c: batch[f"{side}_{c}"][at] for c in ("id", "y", "fold", "lens", "ix", "vx")}
        self.id, self.y, self.fold = (cell[c].values for c in ("id", "y", "fold"))
        self.rank = pc.fill_null(self.id, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        self.folds = self.fold.to_numpy(zero_copy_only=False)
        lens = np.frombuffer(cell["lens"].as_buffer(), np.int32)
        self.n = len(lens)
        self.cols = np.frombuffer(cell["ix"].as_buffer(), np.int32).astype(np.int64)
        self.vals = np.frombuffer(cell["vx"].as_buffer(), np.float64)
        self.rows = np.repeat(np.arange(self.n), lens)
        self.norms = np.bincount(self.rows, weights=self.vals * self.vals, minlength=self.n)


class _Nearest:
    """The k nearest training rows met so far by each row of a query block (ties by training id)."""

    def __init__(self, queries: _Block, k: int):
        self.q, self.k, self.columns = queries, k, _Columns(queries)
        self.row, self.d2, self.rank = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.id, self.y = pa.array([], pa.int64()), pa.array([], pa.int32())
        self.limit = np.full(queries.n, np.inf)  # distance of the k-th, when there are k

    def _found(self, t: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, training row, distance) of the pairs that may be among the k nearest."""
        q, k = self.q, self.k
        if not np.isfinite(self.limit).all():
            d2 = np.concatenate([out for _, out in self.columns.dots(t)]).T * -2.0
            d2 += q.norms[:, None] + t.norms[None, :]
            np.maximum(d2, 0.0, out=d2)
            np.round(d2, 6, out=d2)
            d2[q.folds[:, None] == t.folds[None, :]] = np.inf
            if t.n > k:
                self.limit = np.minimum(self.limit, np.partition(d2, k - 1, axis=1)[:, k - 1])
            row, col = np.nonzero((d2 <= self.limit[:, None]) & np.isfinite(d2))
            return row, col, d2[row, col]
        # a product under this is too far, with room for rounding
        least_q, least_t = q.norms * (0.5 - 1e-12) - self.limit / 2 - 1e-6, t.norms * (0.5 - 1e-12)
        found = []
        for top, out in self.columns.dots(t):
            col, row = np.nonzero(out >= least_t[top : top + len(out), None] + least_q[None, :])
            apart = q.folds[row] != t.folds[top + col]
            row, col = row[apart], col[apart]
            d2 = out[col, row] * -2.0
            d2 += q.norms[row] + t.norms[top + col]
            d2 = np.round(np.maximum(d2, 0.0), 6)
            near = d2 <= self.limit[row]
            found.append((row[near], top + col[near], d2[near]))
        return tuple(np.concatenate(c) for c in zip(*found))

    def meet(self, t: _Block) -> None:
        k = self.k
        row, col, d2 = self._found(t)
        if not len(row):
            return
        row, d2, rank = np.concatenate([self.row, row]), np.concatenate([self.d2, d2]), np.concatenate([self.rank, t.rank[col]])
        source = np.concatenate([np.arange(len(self.row)), len(self.row) + col])
        order = np.lexsort((rank, d2, row))
        row = row[order]
        start = np.nonzero(np.diff(row, prepend=-1))[0]
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
        best = order[place < k]
        self.row, self.d2, self.rank = row[place < k], d2[best], rank[best]
        self.id = pa.concat_arrays([self.id, t.id]).take(pa.array(source[best]))
        self.y = pa.concat_arrays([self.y, t.y]).take(pa.array(source[best]))
        last = place == k - 1
        self.limit[row[last]] = d2[order[last]]

    def out(self, space: str) -> pa.RecordBatch:
        at = pa.array(self.row)
        columns = [pa.array([space] * len(at), pa.string()), self.q.id.take(at), self.q.fold.take(at), self.q.y.take(at), self.id, self.y, pa.array(self.d2)]
        return pa.RecordBatch.from_arrays(columns, names=["space", "qid", "qfold", "qy", "tid", "ty", "d2"])


def _search_blocks(k: int):
    """Kernel over rows of a query block and a training block each: the k best per query and task. The pairs of a
    query block follow one another; if they didn't, only more rows would be left to the final top-k."""

    def run(batches):
        key, space, held = None, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                here = (batch["space"][at].as_py(), batch["block"][at].as_py())
                if here != key:
                    if held is not None:
                        yield held.out(space)
                    key, space, held = here, here[0], _Nearest(_Block(batch, at, "q"), k)
                held.meet(_Block(batch, at, "t"))
        if held is not None:
            yield held.out(space)

    return run


def knn_neighbours(
    feats: DataFrame,
    folds: DataFrame,
    k: int = 11,
    block_rows: int = 4096,
    exclude_dictionary_docs: bool = True,
    queries: DataFrame | None = None,
    query_block_rows: int = 2048,
) -> DataFrame:
    """``qid, qfold, qy, tid, ty, d2``: the k nearest training documents of
    every query document, ties broken by training id.

    ``folds(id, y, fold, in_dictionary)`` are the training documents; a query
    only meets training documents of other folds. Without ``queries`` the test
    rows of ``folds`` are the queries (cross-validation); for prediction the
    queries are new documents with a fold no training row has."""
    if queries is None:
        queries = folds.where(~F.col("in_dictionary")) if exclude_dictionary_docs else folds
    rows = sparse_rows(feats)

    def with_rows(df):
        return df.select("id", "y", "fold").join(rows, "id", "left").withColumn("space", F.lit(""))

    return knn_search(with_rows(folds), with_rows(queries), k, block_rows, query_block_rows).drop("space")


def knn_search(train: DataFrame, tests: DataFrame, k: int = 11, block_rows: int = 4096, query_block_rows: int = 2048) -> DataFrame:
    """``space, qid, qfold, qy, tid, ty, d2``: the k nearest rows of ``train`` for every row of ``tests`` in the same
    ``space`` (a model) and another fold, ties broken by training id.

    Both sides hold ``space, id, y, fold, ix, vx`` (null arrays: no features) and are never mixed, so ids may be equal."""

    def filled(df):
        return df.withColumns({"ix": F.coalesce("ix", F.array().cast("array<int>")), "vx": F.coalesce("vx", F.array().cast("array<double>"))})

    def largest(df):
        return df.groupBy("space").count().agg(F.max("count")).first()[0] or 1

    train, tests = filled(train), filled(tests)
    # query blocks bound the dense query matrix of a task, training blocks the
    # entries it streams; both counts follow the data
    n_train, n_query = largest(train), largest(tests)
    n_tb = max(1, math.ceil(n_train / block_rows))
    n_qb = max(1, math.ceil(n_query / query_block_rows))
    t_parts = max(1, math.ceil(n_tb / TRAIN_BLOCKS))
    # small inputs: at least about two block pairs per core, but no query
    # block under 64 rows, and three tasks per core of blocks of 512 rows or
    # more; large inputs keep the fixed block sizes
    cores = train.sparkSession.sparkContext.defaultParallelism
    n_qb = max(n_qb, min(math.ceil(2 * cores / n_tb), math.ceil(n_query / 64)), min(math.ceil(3 * cores / t_parts), math.ceil(n_query / 512)))

    def blocks(df, n, side):
        rows = df.select("space", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), "id", "y", "fold", "ix", "vx")
        packed = reliable_checkpoint(rows.groupBy("space", "block").applyInArrow(lambda t: _pack_block(t), _BLOCK_SCHEMA))
        return packed.withColumnsRenamed({c: f"{side}_{c}" for c in ("id", "y", "fold", "lens", "ix", "vx")})

    # a task holds some training blocks and takes some query blocks one after the other: the blocks are dealt once, by
    # their number (dealt by chance, some tasks get several and others none), and the join reads each deal again instead
    # of sending copies of it through the shuffle
    q_parts = min(n_qb, max(math.ceil(4 * cores / t_parts), math.ceil(n_qb / QUERY_BLOCKS)))
    q = blocks(tests, n_qb, "q").repartitionById(q_parts, F.col("block") % q_parts)
    t = blocks(train, n_tb, "t").repartitionById(t_parts, F.col("block") % t_parts).drop("block").withColumnRenamed("space", "_space")
    pairs = q.join(t.hint("shuffle_replicate_nl"), F.col("space").eqNullSafe(F.col("_space"))).drop("_space")
    cand = pairs.mapInArrow(_search_blocks(k), _CAND_SCHEMA)
    w = Window.partitionBy("space", "qid").orderBy("d2", "tid")
    return cand.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def knn_votes(neigh: DataFrame, learner: str = "knn", space: list[str] | None = None) -> DataFrame:
    """Distance-weighted vote: weights 1/d; when a neighbour is at distance 0
    only the zero-distance neighbours vote, with weight 1; ties go to -1. ``space`` names further key columns."""
    keys = space or []
    zero = F.max(F.when(F.col("d2") == 0, 1).otherwise(0)).over(Window.partitionBy(*keys, "qid"))
    weighted = neigh.withColumn(
        "wt",
        F.when(zero == 1, F.when(F.col("d2") == 0, 1.0).otherwise(0.0)).otherwise(1.0 / F.sqrt("d2")),
    )
    sums = weighted.groupBy(*keys, "qid", "qfold", "qy").agg(
        F.sum(F.when(F.col("ty") == 1, F.col("wt")).otherwise(0.0)).alias("w_pos"),
        F.sum(F.when(F.col("ty") == -1, F.col("wt")).otherwise(0.0)).alias("w_neg"),
    )
    vote = F.when(F.round("w_pos", 6) > F.round("w_neg", 6), 1).otherwise(-1).cast("int")
    return sums.select(
        *keys, F.col("qid").alias("id"), F.col("qfold").alias("fold"), F.lit(learner).alias("learner"), vote.alias("vote"),
        F.col("qy").alias("y"),
    )


# ------------------------------------------------------------------ scaling
def standard_scale(long: DataFrame, key: str = "id", dim: str = "dim", value: str = "value") -> DataFrame:
    """M4 on long-form dense rows: (v - mean) / std per dimension, population
    std (Q9), a zero std left as 1. Stats come from a per-dimension
    aggregation (partial, one row per dimension) joined back, broadcast when
    the dimension count is under the row limit."""
    stats = long.groupBy(dim).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    return long.join(checked_broadcast(stats), dim).select(
        key, dim, ((F.col(value) - F.col("_mu")) / F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))).alias(value)
    )


# ---------------------------------------------------- pyspark.ml voters
@dataclass
class MLVoter:
    """A pyspark.ml classifier used as a voter (label 1.0 = pos). Boosted trees of more than a chunk of rows are
    grown by ``boosting.py``, linear SVMs of many features fitted by ``svm.py``, with the same settings."""

    name: str
    weighted: bool  # takes sample weights (M11)

    def estimator(self, n_train: int, n_features: int, weight_col: str | None):
        from pyspark.ml.classification import GBTClassifier, LinearSVC

        if self.name == "svm_linear":
            est = LinearSVC(maxIter=SVM.MAX_ITER, regParam=1.0 / max(n_train, 1), featuresCol="features", labelCol="label")
            if weight_col and self.weighted:
                est.setWeightCol(weight_col)
            return est
        if self.name == "boosting":
            return GBTClassifier(maxIter=BT.ROUNDS, maxDepth=BT.DEPTH, stepSize=BT.STEP, featuresCol="features", labelCol="label", seed=7)
        raise ValueError(self.name)


#: Random Fourier features of the RBF voter, and entries projected at once.
RFF_COMPONENTS, RFF_STRIP = 256, 16_384


def rff_features(long: DataFrame, n_features: int, n_components: int = RFF_COMPONENTS, gamma: float | None = None, seed: int = 11,
                 ids: DataFrame | None = None):
    """M6 helper: random Fourier features z(x) = sqrt(2/D) cos(W x + b) for the
    RBF kernel exp(-gamma |x - y|^2) (Rahimi & Recht 2007). Rows of W are drawn
    per feature index from a seeded generator inside each task, so nothing of
    size n_features x D is shipped. Returns ``id, z``; Arrow batches are cut to
    strips of entries, so a batch of long documents takes no more memory."""
    g = gamma if gamma is not None else 1.0 / max(n_features, 1)
    scale = math.sqrt(2.0 * g)
    d = n_components
    b = np.random.default_rng(seed).uniform(0, 2 * math.pi, d)

    def strips(batches):
        for pdf in batches:
            ends = np.cumsum([len(x) for x in pdf["ix"]])
            start = 0
            while start < len(pdf):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + RFF_STRIP, side="right")))
                yield pdf.iloc[start:stop]
                start = stop

    def project(batches):
        cache: dict[int, np.ndarray] = {}
        for pdf in strips(batches):
            lens, ix, vx = _flatten(list(pdf["ix"]), list(pdf["vx"]))
            uniq, inv = np.unique(ix, return_inverse=True)
            for j in uniq:
                if int(j) not in cache:
                    cache[int(j)] = np.random.default_rng([seed, int(j)]).standard_normal(d) * scale
            w = np.stack([cache[int(j)] for j in uniq]) if len(uniq) else np.zeros((0, d))
            acc = np.zeros((len(pdf), d))
            nonempty = lens > 0
            if nonempty.any():
                starts = (np.cumsum(lens) - lens)[nonempty]
                acc[nonempty] = np.add.reduceat(w[inv] * vx[:, None], starts, axis=0)
            z = np.sqrt(2.0 / d) * np.cos(acc + b)
            yield pd.DataFrame({"id": pdf["id"], "z": list(z)})

    rows = sparse_rows(long)
    if ids is not None:
        # documents without any feature still get z(0) = sqrt(2/D) cos(b)
        rows = ids.select("id").join(rows, "id", "left").select(
            "id",
            F.coalesce("ix", F.array().cast("array<int>")).alias("ix"),
            F.coalesce("vx", F.array().cast("array<double>")).alias("vx"),
        )
    return rows.mapInPandas(project, "id long, z array<double>")


def rff_long(long: DataFrame, n_features: int, ids: DataFrame, n_components: int = RFF_COMPONENTS) -> DataFrame:
    """The random Fourier features as samples ``id, idx, value``."""
    return rff_features(long, n_features, n_components, ids=ids).select("id", F.posexplode("z").alias("idx", "value"))


def _class_counts(folds: DataFrame, n_folds: int) -> dict[int, dict[int, int]]:
    """Training rows per class for every fold: one tiny aggregate (2 x n_folds rows)."""
    per = {(r.fold, r.y): r.n for r in folds.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    tot = {y: sum(n for (f, yy), n in per.items() if yy == y) for y in (1, -1)}
    return {f: {y: tot[y] - per.get((f, y), 0) for y in (1, -1)} for f in range(n_folds)}


def _per_fold(fn, n_folds: int, workers: int = 4):
    """Run ``fn(f)`` for every fold from a small thread pool: each call
    submits its own Spark jobs, which the scheduler runs side by side."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=min(workers, n_folds)) as pool:
        return list(pool.map(fn, range(n_folds)))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for o in frames[1:]:
        out = out.unionByName(o)
    return out


def _boosted_votes(vectors: DataFrame, folds: DataFrame, exclude_dictionary_docs: bool, n_folds: int) -> DataFrame:
    data = vectors.join(folds, "id").where(F.col("fold").between(0, n_folds - 1)).select("id", "y", "fold", "in_dictionary", "features")
    data = reliable_checkpoint(BT.sparse_vectors(data))
    tests = data.where(~F.col("in_dictionary")) if exclude_dictionary_docs else data
    scored = BT.score(tests, BT.fit(data, n_folds), ["id", "fold", "y"], model="fold")
    vote = F.when(F.col("margin") > 0, 1).otherwise(-1).cast("int")
    return reliable_checkpoint(scored.select("id", "fold", F.lit("boosting").alias("learner"), vote.alias("vote"), "y"))


def _svm_votes(vectors: DataFrame, folds: DataFrame, n_features: int, weight_col: str | None, exclude_dictionary_docs: bool, n_folds: int) -> DataFrame:
    counts = _class_counts(folds, n_folds)
    reg = {f: 1.0 / (c[1] + c[-1]) for f, c in counts.items() if c[1] and c[-1]}
    joined = vectors.join(folds, "id")
    test = F.col("fold").between(0, n_folds - 1)
    if exclude_dictionary_docs:
        test = test & ~F.col("in_dictionary")
    kinds = {c: joined.schema[c].dataType for c in ("id", "fold", "y")}

    def votes(rows: DataFrame, vote: Column) -> DataFrame:
        own = {c: F.col(c).cast(kind).alias(c) for c, kind in kinds.items()}
        return rows.select(own["id"], own["fold"], F.lit("svm_linear").alias("learner"), vote.cast("int").alias("vote"), own["y"])

    out = []
    if reg:
        fitted = SVM.fit(SVM.rows(joined, weight_col, test), n_features, reg)
        out.append(votes(SVM.margins(fitted, list(reg)), F.when(F.col("margin") > 0, 1).otherwise(-1)))
        fitted.cells.unpersist()
    for f in range(n_folds):
        if f not in reg:  # one class only: every vote is that class
            only = next((y for y in (1, -1) if counts[f][y]), -1)
            out.append(votes(joined.where(test & (F.col("fold") == f)), F.lit(only)))
    return _union(out)


def ml_fold_votes(
    voter: MLVoter,
    vectors: DataFrame,
    folds: DataFrame,
    n_features: int,
    weight_col: str | None = None,
    exclude_dictionary_docs: bool = True,
    n_folds: int = 10,
    scale: bool = False,
) -> DataFrame:
    """Fit on ``fold <> f`` and vote on ``fold = f`` (U3) for every fold.

    ``scale`` (dense features, M4): a standard scaler is fitted on the
    training rows of each fold and applied to both sides, as the reference
    does for reduced (dense) samples.

    The joined training data is written to the checkpoint folder once (the
    iterative solvers read it many times); the folds are fitted concurrently
    and their votes materialised, so the returned frame does not refit.
    Boosted trees of all folds are fitted together (scaling doesn't change them);
    rows that fit in one chunk take less time in pyspark.ml's own solver. So are
    linear SVMs of more features than the driver should get a gradient of in
    each step; they scale the features themselves."""
    if voter.name == "boosting" and folds.count() > BT.ROWS:
        return _boosted_votes(vectors, folds, exclude_dictionary_docs, n_folds)
    if voter.name == "svm_linear" and n_features > SVM.DRIVER_FEATURES:
        return _svm_votes(vectors, folds, n_features, weight_col if voter.weighted else None, exclude_dictionary_docs, n_folds)
    data = vectors.join(folds, "id").withColumn("label", (F.col("y") == 1).cast("double"))
    if weight_col:
        data = data.withColumn(weight_col, F.col(weight_col).cast("double"))
    data = reliable_checkpoint(data)
    counts = _class_counts(folds, n_folds)

    def one(f: int) -> DataFrame:
        train = data.where(F.col("fold") != f)
        test = data.where(F.col("fold") == f)
        if exclude_dictionary_docs:
            test = test.where(~F.col("in_dictionary"))
        present = [y for y, n in counts[f].items() if n > 0]
        if len(present) < 2:
            # one class only: every vote is that class
            only = present[0] if present else -1
            votes = test.select("id", "fold", F.lit(voter.name).alias("learner"), F.lit(only).alias("vote"), "y")
        else:
            n_train = counts[f][1] + counts[f][-1]
            est = voter.estimator(n_train, n_features, weight_col)
            if scale:
                from pyspark.ml import Pipeline
                from pyspark.ml.feature import StandardScaler

                est = Pipeline(stages=[
                    StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="_scaled"),
                    est.copy().setFeaturesCol("_scaled"),
                ])
            model = est.fit(train)
            votes = model.transform(test).select(
                "id", "fold", F.lit(voter.name).alias("learner"),
                F.when(F.col("prediction") > 0.5, 1).otherwise(-1).cast("int").alias("vote"), "y",
            )
        return reliable_checkpoint(votes)

    return _union(_per_fold(one, n_folds))
