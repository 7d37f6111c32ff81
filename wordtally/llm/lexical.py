"""Ranked lexical search over document FP-trees (operator 11).

The items (queries) are dealt into blocks of a bounded number of terms. For a
block, one scan of the documents keeps of each its term vector restricted to
the block's terms, stored as Parquet with the document's length; counts over
that table give the document frequencies. Then every partition of the vectors
builds trees and answers the whole block:

* A document's restricted terms, most frequent first, are a path of a trie;
  documents that share their frequent terms share the path. Chains are
  compressed and small neighbouring subtrees share a leaf of at most
  ``LEAF_DOCS`` documents (equal vectors always share one).
* A node knows, over its subtree, the largest tf of each term that occurs and
  the smallest m. A score grows with tf and falls with m, so the item's score
  on these extremes bounds every document below.
* Each item walks the tree depth first, the child with the highest bound
  first, and leaves a subtree out once its bound is below the item's tenth
  best score so far. An equal bound is followed, as a smaller id may win.

The ten best so far are carried from tree to tree of a partition; a partition
returns at most ten rows an item and a window takes the ten best of those.
Memory: ``TREE_POSTINGS`` entries of one tree and the terms of one block,
whatever the size of the table, of a text or of a group of copies.

Defined cases: a null or empty text, document or item, has no terms: such a
document isn't counted, such an item has no rows; a long text is read whole;
documents without ``doc_id`` rank after equal scores that have one; rows with
equal ids are documents of their own; equal benchmark rows are one item, equal
item ids with different texts are items of their own under one id; an empty
table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordtally.llm.common import Work, map_rows, slices

TOP = 10
#: Terms (with repeats) that one block of items holds, as dealt by hash.
BLOCK_TERMS = 1 << 17
#: Term entries of one tree.
TREE_POSTINGS = 4_000_000
LEAF_DOCS = 32
#: Maps A-Z to lower case and all ASCII but letters and digits to a space; bytes of other characters stay.
SPLIT = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, as UTF-8."""
    return (text or "").encode().translate(SPLIT).split()


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def restricted(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), ids and tfs of the block's terms, of every document with a term."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        known = vocabulary.value
        out: dict[str, list] = {"doc_id": [], "n": [], "ids": [], "tfs": []}
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            words = terms(text)
            if words:
                held = [(known[w], tf) for w, tf in Counter(words).items() if w in known]
                out["doc_id"].append(doc_id)
                out["n"].append(len(words))
                out["ids"].append([i for i, _ in held])
                out["tfs"].append([tf for _, tf in held])
        return out

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n long, ids array<int>, tfs array<int>")


class Tree:
    """FP-tree of documents given by flat arrays: ``sizes`` entries each, ``rank`` (0 is the most frequent term) and ``tf``."""

    def __init__(self, doc_ids: list, m: np.ndarray, sizes: np.ndarray, rank: np.ndarray, tf: np.ndarray, n_terms: int):
        self.n_terms = n_terms
        by = np.argsort(np.repeat(np.arange(len(sizes)), sizes) * n_terms + rank, kind="stable")
        rank, tf = rank[by], tf[by]
        start = np.concatenate(([0], np.cumsum(sizes)))
        paths = rank.astype(">u4").tobytes()
        order = np.array(sorted(range(len(sizes)), key=lambda d: paths[4 * start[d] : 4 * start[d + 1]]), dtype=np.int64)
        sizes = sizes[order]
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        take = np.repeat(start[order] - self.start[:-1], sizes) + np.arange(self.start[-1])
        self.rank, self.tf, self.m = rank[take], tf[take], m[order]
        self.docs = [doc_ids[d] for d in order]
        self.gain = gain(self.tf, np.repeat(self.m, sizes))
        self._grow(sizes)
        self._bounds()

    def _grow(self, sizes: np.ndarray) -> None:
        """Nodes in breadth-first order: documents lo..hi, children from ``first`` on (none for a leaf)."""
        lo, hi, parent, first, last = [0], [len(sizes)], [-1], [], []
        depth, at = [0], 0
        while at < len(lo):
            a, b, d = lo[at], hi[at], depth[at]
            cuts: list[int] = []
            while b - a > LEAF_DOCS:
                longer = sizes[a:b] > d
                step = np.full(b - a, -1)
                step[longer] = self.rank[self.start[a:b][longer] + d]
                cuts = (np.nonzero(step[1:] != step[:-1])[0] + 1 + a).tolist()
                if cuts or step[0] < 0:  # a branching, or equal vectors only
                    break
                d += 1
            first.append(len(lo))
            if cuts:
                begin = prev = a
                for end in [*cuts, b]:
                    if end - begin > LEAF_DOCS and prev > begin:  # small neighbours so far share a node
                        self._child(lo, hi, parent, depth, begin, prev, at, d)
                        begin = prev
                    if end - begin > LEAF_DOCS or end == b:
                        self._child(lo, hi, parent, depth, begin, end, at, d + 1)
                        begin = end
                    prev = end
            last.append(len(lo))
            at += 1
        self.lo, self.hi, self.first, self.last, self.parent = lo, hi, first, last, np.array(parent)

    @staticmethod
    def _child(lo, hi, parent, depth, a, b, at, d) -> None:
        lo.append(a)
        hi.append(b)
        parent.append(at)
        depth.append(d)

    def _bounds(self) -> None:
        """Subtree maxima of tf (sorted keys node * n_terms + rank) and minima of m."""
        lo, hi = np.array(self.lo), np.array(self.hi)
        leaf = np.array(self.first) == np.array(self.last)
        level = np.zeros(len(lo), dtype=np.int64)
        for i in range(1, len(lo)):
            level[i] = level[self.parent[i]] + 1
        home = np.zeros(len(self.m), dtype=np.int64)
        for i in np.nonzero(leaf)[0].tolist():
            home[lo[i] : hi[i]] = i
        keys = np.repeat(home, np.diff(self.start)) * self.n_terms + self.rank
        keys, top = _largest(keys, self.tf)
        done = [(keys, top)]
        for deep in range(int(level.max()), 0, -1):  # entries of nodes at this level go up to their parents
            here = level[keys // self.n_terms] == deep
            up = self.parent[keys[here] // self.n_terms] * self.n_terms + keys[here] % self.n_terms
            up, most = _largest(up, top[here])
            done.append((up, most))
            keys, top = np.concatenate((keys[~here], up)), np.concatenate((top[~here], most))
        self.keys, self.top = _largest(np.concatenate([k for k, _ in done]), np.concatenate([t for _, t in done]))
        self.least = np.array([self.m[a:b].min() for a, b in zip(self.lo, self.hi)])

    def bounds(self, a: int, b: int, ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Upper bounds of the item's score in the subtrees of nodes a..b."""
        want = np.arange(a, b)[:, None] * self.n_terms + ranks[None, :]
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        tf = np.where(self.keys[at] == want, self.top[at], 0)
        return (weights * gain(tf, self.least[a:b, None])).sum(axis=1)

    def search(self, ranks: np.ndarray, weights: np.ndarray, lookup: np.ndarray, best: list) -> None:
        """Merge the item's best documents into ``best``: sorted (-score, id is null, id), TOP at most."""
        lookup[ranks] = weights
        stack = [(int(self.bounds(0, 1, ranks, weights)[0]), 0)]
        while stack:
            bound, node = stack.pop()
            if bound <= 0 or (len(best) == TOP and bound < -best[-1][0]):
                continue
            a, b = self.first[node], self.last[node]
            if a < b:
                bound = self.bounds(a, b, ranks, weights)
                floor = -best[-1][0] if len(best) == TOP else 1
                stack += sorted((v, a + i) for i, v in enumerate(bound.tolist()) if v >= floor)
                continue
            a, b = self.lo[node], self.hi[node]
            at = self.start[a : b + 1]
            scores = np.add.reduceat(lookup[self.rank[at[0] : at[-1]]] * self.gain[at[0] : at[-1]], at[:-1] - at[0])
            floor = -best[-1][0] if len(best) == TOP else 1
            for i in np.nonzero(scores >= floor)[0].tolist():
                doc = self.docs[a + i]
                bisect.insort(best, (-int(scores[i]), doc is None, doc or 0))
                del best[TOP:]
        lookup[ranks] = 0


def _largest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with its largest value."""
    by = np.argsort(keys, kind="stable")
    keys, values = keys[by], values[by]
    heads = np.nonzero(np.diff(keys, prepend=-1))[0]
    return keys[heads], np.maximum.reduceat(values, heads) if len(heads) else values


def answers(vectors: DataFrame, block, n_docs: int, n_terms_all: int) -> DataFrame:
    """(q, doc_id, score): at most TOP rows of each item and partition. ``block`` broadcasts (rank by term id, items)."""

    def trees(batches: Iterator[pa.RecordBatch], rank_of: np.ndarray) -> Iterator[Tree]:
        held: list[tuple] = []
        entries = 0

        def tree() -> Tree:
            ids, m, sizes, rank, tf = zip(*held)
            return Tree([x for part in ids for x in part], np.concatenate(m), np.concatenate(sizes), np.concatenate(rank), np.concatenate(tf), len(rank_of))

        for part in slices(batches, 4096):
            sizes = part["ids"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            some = sizes > 0  # without a term of the block the score is 0
            m = np.array([25 + (75 * n * n_docs) // n_terms_all for n in part["n"].to_pylist()], dtype=np.int64)
            rank = rank_of[part["ids"].flatten().to_numpy(zero_copy_only=False)]
            tf = part["tfs"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            held.append(([x for x, s in zip(part["doc_id"].to_pylist(), some) if s], m[some], sizes[some], rank, tf))
            entries += len(rank)
            if entries >= TREE_POSTINGS:
                yield tree()
                held, entries = [], 0
        if entries:
            yield tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of, items = block.value
        lookup = np.zeros(len(rank_of), dtype=np.int64)
        best: dict[int, list] = {q: [] for q in items}
        for tree in trees(batches, rank_of):
            for q, (ranks, weights) in items.items():
                tree.search(ranks, weights, lookup, best[q])
        rows = [(q, None if null else doc, -score) for q, found in best.items() for score, null, doc in found]
        if rows:
            q, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["q", "doc_id", "score"])

    return vectors.mapInArrow(run, "q int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, work: Work) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents of every item."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.length("text")).alias("chars")).first()["chars"] or 0
    blocks = 1 + size // (4 * BLOCK_TERMS)  # a term and its separator are rarely under four characters
    dealt = work.store(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    found = spark.createDataFrame([], "block int, item_id long, q int, doc_id long, score long")
    for number in range(blocks):  # one scan of the documents for each block of items
        asked = {q: (r["item_id"], Counter(terms(r["text"]))) for q, r in enumerate(dealt.where(F.col("block") == number).collect())}
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, c in asked.values() for t in c}))}
        if not vocabulary:
            continue
        vectors = work.store(restricted(docs, spark.sparkContext.broadcast(vocabulary)), f"vectors_{number}")
        total = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            continue
        df = dict(vectors.select(F.explode("ids").alias("id")).groupBy("id").count().collect())  # at most a row a term of the block
        order = sorted(range(len(vocabulary)), key=lambda i: (-df.get(i, 0), i))
        rank_of = np.empty(len(order), dtype=np.int64)
        rank_of[order] = np.arange(len(order))
        weights = {t: weight(df[i], total["docs"]) for t, i in vocabulary.items() if df.get(i)}
        live = {}
        for q, (_, counts) in asked.items():
            used = [(rank_of[vocabulary[t]], weights[t] * c) for t, c in counts.items() if weights.get(t)]
            if used:
                live[q] = tuple(np.array(x, dtype=np.int64) for x in zip(*used))
        best = answers(vectors, spark.sparkContext.broadcast((rank_of, live)), total["docs"], total["terms"])
        names = spark.createDataFrame([(number, item, q) for q, (item, _) in asked.items()], "block int, item_id long, q int")
        found = found.unionByName(work.store(best.join(F.broadcast(names), "q"), f"best_{number}"))
        work.drop(f"vectors_{number}")
    order = Window.partitionBy("block", "q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")
