"""Nearest neighbours with robust-pruned directed graphs, one per shard (operator 7).

Equal vectors become one node that keeps its smallest ids (as many as an answer
can need), so copies neither crowd a graph nor a task. Nodes are dealt to shards
of bounded size by hash. In a shard, nodes are inserted in batches: a greedy
beam search over the graph so far proposes neighbours, and relaxed distance
pruning keeps the diverse ones; links are made in both directions, and a second
round refines them. Every shard answers every block of queries by beam search;
what it finds is scored again in double precision on the original vectors, and
the best of all shards are kept.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part; vectors of different length are never compared; ties
go to the smaller id; a repeated id counts once per distinct vector; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordtally.llm.common import Work

SHARD_ROWS = 8192
BLOCK_ROWS = 1024
DEGREE = 32
#: Beam widths of building and of searching, nodes expanded at a time, relaxation of the pruning.
BUILD_BEAM = 64
SEARCH_BEAM = 128
EXPAND = 4
ALPHA = 1.2
BATCH = 512


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances), nearest first, of the best ``beam`` nodes met for each query; -1 where there are fewer."""
    b, n = len(queries), len(x)
    ids = np.full((b, beam), -1, dtype=np.int64)
    dist = np.full((b, beam), np.inf, dtype=np.float32)
    open_ = np.zeros((b, beam), dtype=bool)
    ids[:, 0], open_[:, 0] = entry, True
    dist[:, 0] = 2 - 2 * queries @ x[entry]
    seen = np.zeros((b, n + 1), dtype=bool)
    seen[:, entry] = seen[:, n] = True
    stamp = np.zeros((b, n + 1), dtype=np.int32)
    live = np.arange(b)
    while len(live):
        order = np.argsort(~open_[live], axis=1, kind="stable")[:, :EXPAND]  # nearest open ones first
        r = live[:, None]
        take = open_[r, order]
        open_[r, order] = False
        nbr = np.where(take[:, :, None], graph[np.maximum(ids[r, order], 0)], -1).reshape(len(live), -1)
        nbr = np.where(nbr < 0, n, nbr)
        col = np.arange(nbr.shape[1], dtype=np.int32)[None, :]
        stamp[r, nbr] = col
        new = ~seen[r, nbr] & (stamp[r, nbr] == col)
        seen[r, nbr] = True
        d = np.full(nbr.shape, np.inf, dtype=np.float32)
        i, j = np.nonzero(new)
        d[i, j] = 2 - 2 * np.einsum("ij,ij->i", x[nbr[i, j]], queries[live[i]])
        all_d = np.concatenate([dist[live], d], axis=1)
        all_i = np.concatenate([ids[live], np.where(new, nbr, -1)], axis=1)
        all_o = np.concatenate([open_[live], new], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        at = np.arange(len(live))[:, None]
        dist[live], ids[live], open_[live] = all_d[at, best], all_i[at, best], all_o[at, best]
        live = live[open_[live].any(axis=1)]
    return ids, dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """At most DEGREE diverse neighbours of each node among its candidates (-1: none), nearest first."""
    b, c = cand.shape
    bad = (cand < 0) | (cand == nodes[:, None])
    v = x[np.maximum(cand, 0)]
    d = np.where(bad, np.inf, np.maximum(0, 2 - 2 * np.einsum("bcd,bd->bc", v, x[nodes])))
    order = np.argsort(d, axis=1, kind="stable")
    at = np.arange(b)[:, None]
    cand, d, v = cand[at, order], np.sqrt(d[at, order]), v[at, order]
    alive = np.isfinite(d)
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bcd,bed->bce", v, v, optimize=True)))
    out = np.full((b, DEGREE), -1, dtype=np.int64)
    count = np.zeros(b, dtype=np.int64)
    for k in range(c):
        pick = alive[:, k] & (count < DEGREE)
        if not pick.any():
            continue
        p = np.nonzero(pick)[0]
        out[p, count[p]] = cand[p, k]
        count[p] += 1
        alive[p] &= ALPHA * between[p, k] > d[p]
    return out


def build(x: np.ndarray) -> tuple[np.ndarray, int]:
    """(graph, entry) of unit vectors: rows of at most DEGREE neighbours, -1 padded."""
    n = len(x)
    entry = int(np.argmax(x @ x.mean(axis=0)))
    graph = np.full((n, DEGREE), -1, dtype=np.int64)
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    for round_ in range(2):
        done = 1 if round_ == 0 else 0
        while done < n:
            batch = order[done : done + min(BATCH, max(1, done) if round_ == 0 else BATCH)]
            done += len(batch)
            found, _ = beam_search(x, graph, entry, x[batch], BUILD_BEAM)
            graph[batch] = robust_prune(x, batch, np.concatenate([found, graph[batch]], axis=1))
            # links back; nodes with more than DEGREE are pruned again
            src, col = np.nonzero(graph[batch] >= 0)
            to, frm = graph[batch][src, col], batch[src]
            s = np.argsort(to, kind="stable")
            to, frm = to[s], frm[s]
            heads, start, size = np.unique(to, return_index=True, return_counts=True)
            for low in range(0, len(heads), 256):
                h, st, sz = heads[low : low + 256], start[low : low + 256], size[low : low + 256]
                extra = np.full((len(h), int(sz.max())), -1, dtype=np.int64)
                rr = np.repeat(np.arange(len(h)), sz)
                cc = np.arange(int(sz.sum())) - np.repeat(np.cumsum(sz) - sz, sz)
                extra[rr, cc] = frm[np.repeat(st, sz) + cc]
                extra[(extra[:, :, None] == graph[h][:, None, :]).any(axis=2)] = -1
                both = np.concatenate([graph[h], extra], axis=1)
                full = (both >= 0).sum(axis=1) > DEGREE
                if (~full).any():
                    graph[h[~full]] = -np.sort(-both[~full], axis=1)[:, :DEGREE]
                if full.any():
                    graph[h[full]] = robust_prune(x, h[full], both[full])
    return graph, entry


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def index_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Graph of the vectors of one shard, as one row of bytes; ``ids`` holds the smallest ids of each vector."""
    pdf = pdf.sort_values("first", kind="stable")
    v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    graph, entry = build(_unit(v))
    ids = pdf["ids"].tolist()
    return pd.DataFrame({
        "dim": [v.shape[1]], "shard": [int(pdf["shard"].iloc[0])], "entry": [entry], "vectors": [v.astype(np.float32).tobytes()], "graph": [graph.astype(np.int32).tobytes()],
        "ids": [np.concatenate([np.asarray(i, dtype=np.int64) for i in ids]).tobytes()], "counts": [np.array([len(i) for i in ids], dtype=np.int32).tobytes()],
    })


def search_shard(shard: dict, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest ids of a shard for each query, by cosine in double precision."""
    dim = shard["dim"]
    v = np.frombuffer(shard["vectors"], dtype=np.float32).reshape(-1, dim).astype(np.float64)
    graph = np.frombuffer(shard["graph"], dtype=np.int32).reshape(-1, DEGREE).astype(np.int64)
    counts = np.frombuffer(shard["counts"], dtype=np.int32)
    ids = np.frombuffer(shard["ids"], dtype=np.int64)
    first = np.cumsum(counts) - counts
    found, _ = beam_search(_unit(v), graph, shard["entry"], _unit(queries), SEARCH_BEAM)
    found = found[:, : 4 * (k + 1)]
    norm = np.linalg.norm(v, axis=1)
    cos = np.einsum("bcd,bd->bc", v[np.maximum(found, 0)], queries) / (norm[np.maximum(found, 0)] * np.linalg.norm(queries, axis=1)[:, None])
    out = []
    for q, row, score in zip(query_ids.tolist(), found.tolist(), cos.tolist()):
        near = [(-s, int(i)) for n, s in zip(row, score) if n >= 0 for i in ids[first[n] : first[n] + counts[n]] if i != q]
        out += [(q, i, -s) for s, i in sorted(near)[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(vectors: DataFrame, work: Work, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors of each vector whose id is divisible by ``every``."""
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    valid = vectors.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # equal vectors: the smallest k + 1 ids of each (limited before the shuffle, so copies stay few)
    w = Window.partitionBy("embedding").orderBy("vec_id")
    few = valid.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    nodes = few.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    nodes = work.store(nodes.select(F.size("embedding").alias("dim"), "embedding", "ids", F.col("ids")[0].alias("first")), "nodes")
    shards = max(1, -(-nodes.count() // SHARD_ROWS))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(shards)))
    index = dealt.groupBy("dim", "shard").applyInPandas(lambda pdf: index_shard(pdf), "dim int, shard long, entry int, vectors binary, graph binary, ids binary, counts binary")
    index = work.store(index, "graphs")
    queries = valid.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "embedding"])
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    packed = queries.groupBy(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("q"))  # about BLOCK_ROWS queries
    asked = packed.select(F.col("dim").alias("q_dim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("q_shard"), "q")
    # dealt by shard and block, so that one task holds one shard and one block at a time; never broadcast: before they
    # are repeated for every shard the blocks look small, and the driver would gather queries times shards
    pairs = asked.hint("merge").join(index, (asked.q_dim == index.dim) & (asked.q_shard == index.shard)).drop("q_dim", "q_shard")

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids = np.array([q["vec_id"] for q in row["q"]], dtype=np.int64)
                vec = np.array([q["embedding"] for q in row["q"]], dtype=np.float64)
                for low in range(0, len(ids), 256):
                    out = search_shard(row, ids[low : low + 256], vec[low : low + 256], k)
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
