"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios (operator 10).

Features are the distinct character n-grams (4 to 8, within a word and its
borders) of a whole lower-cased text, hashed. On labelled training rows each
feature's log-count ratio between the classes is estimated; features whose
ratio is small or within chance (fewer than 4 standard errors from zero, as some
hundred thousand are looked at) tell nothing and are left out. Sizes, errors and
ridge were chosen by cross-validation inside the training fold. A logistic regression is
fitted on presence times ratio, and every document is scored by the sum of the
weights of its n-grams.

The log-count ratios count all labelled training rows in one aggregation of at
most 2^BITS features. The regression is fitted in one task on at most
``MAX_ROWS`` training rows of each class (those with the least hash of
``doc_id``), each weighted by the rows of its class that it stands for, so the
balance of the classes is that of all labelled rows, whatever the cap leaves.
Only features with evidence reach the driver, at most 2^BITS, and their weights
travel inside the scoring function. Very long texts are read whole.

Defined cases: a null or empty text has no features and gets the score of the
intercept; null labels are not learnt from; a document with repeated labels counts once
and one with contradicting labels not at all; without rows of both classes every
score is 0; repeated rows are scored one by one; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtally.llm.common import Work, bit_table, in_bit_table, in_training_fold, map_rows, slices

BITS = 20
SIZES = (4, 5, 6, 7, 8)
#: Training rows of each class, at most.
MAX_ROWS = 4_000
#: How far a feature's log-count ratio must be from zero, and by how many of its standard errors.
LEAST_RATIO = 1.0
LEAST_ERRORS = 4.0
RIDGE = 2e-4
STEPS = 400
THRESHOLD = 0.5


def hashes(text: str | None) -> np.ndarray:
    """Hashed ids of the n-grams of a whole text, with repeats; each size goes on from the hashes of the one before."""
    words = set((text or "").lower().split())
    line = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    space = line == 32
    h, inner, out = np.zeros(len(line), dtype=np.uint64), np.zeros(len(line), dtype=bool), []
    for size in range(1, SIZES[-1] + 1 if words else 0):
        n = len(line) - size + 1
        if n < 1:
            break
        h = (h[:n] ^ line[size - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        inner = inner[:n]
        if size > 2:  # a space between the first and the last character
            inner = inner | space[size - 2 : size - 2 + n]
        if size in SIZES:
            out.append(((h >> np.uint64(20)) & np.uint64((1 << BITS) - 1))[~inner].astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


def features(text: str | None) -> np.ndarray:
    """Hashed ids of the distinct n-grams of a whole text, ascending."""
    return np.unique(hashes(text))


def fit(label: np.ndarray, rows: list[np.ndarray], used: np.ndarray, ratio: np.ndarray, totals: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature ids, weights on presence, intercept): weighted logistic regression on presence times log-count ratio.

    ``used`` are the features with evidence and ``ratio`` their log-count ratios, ``totals`` all clean and toxic rows; ``rows`` are a sample.
    """
    pos, neg = label == 1, label == 0
    if not pos.any() or not neg.any() or not len(used):
        return np.zeros(0, dtype=np.int64), np.zeros(0), -50.0
    size = 1 << BITS
    weight = np.where(pos, totals[1] / pos.sum(), totals[0] / neg.sum())
    weight = weight / weight.sum()
    slot = np.full(size, -1)
    slot[used] = np.arange(len(used))
    cols = [slot[r] for r in rows]
    cols = [c[c >= 0] for c in cols]
    row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    col = np.concatenate(cols).astype(np.int64)
    value = ratio[col]
    y = label.astype(float)
    w, b = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, weights=w[col] * value, minlength=len(y)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        g = np.append(np.bincount(col, weights=d[row] * value, minlength=len(used)) + RIDGE * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return used, w * ratio, float(b)


def with_key_in(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose doc_id is (but for a few chance hits) one of ``known``, so that a join shuffles no text of the others."""
    key = F.xxhash64("doc_id").alias("key")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(known.select(key), "key"))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bit_table(table.value, batch["key"].to_numpy())))

    keyed = docs.select("*", key)
    return keyed.mapInArrow(run, keyed.schema).drop("key")


def feature_counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """f, p, q: toxic and clean rows of every feature over all labelled rows ``known`` (doc_id, y); f = 2^BITS counts all rows."""
    rows = with_key_in(docs.where(in_training_fold(F.col("doc_id"))).select("doc_id", "text"), known)
    rows = rows.join(known.hint("merge"), "doc_id").select("y", "text")  # labels grow with the corpus: no broadcast
    size = 1 << BITS

    def run(batches):
        n = np.zeros((2, size + 1), dtype=np.int64)  # the last one counts rows
        for part in slices(batches):
            for y, t in zip(part.column("y").to_pylist(), part.column("text").to_pylist()):
                n[y, hashes(t)] += 1  # repeats count once
                n[y, size] += 1
        at = np.nonzero(n.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[1, at]), pa.array(n[0, at])], ["f", "p", "q"])

    return rows.mapInArrow(run, "f int, p long, q long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def evidence(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """(features, log-count ratios) of those clearly away from zero, and (clean, toxic) rows in all."""
    rows = counts.where(F.col("f") == 1 << BITS).first()
    toxic, clean = (rows["p"], rows["q"]) if rows else (0, 0)
    ratio = F.log((F.col("p") + 1) / (toxic + 2)) - F.log((F.col("q") + 1) / (clean + 2))
    error = F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("q") + 1))
    some = counts.where(F.col("f") < 1 << BITS).select("f", ratio.alias("ratio"), error.alias("error"))
    some = some.where((F.abs("ratio") >= LEAST_RATIO) & (F.abs("ratio") >= LEAST_ERRORS * F.col("error"))).orderBy("f").toArrow()  # at most 2^BITS rows
    return some["f"].to_numpy(), some["ratio"].to_numpy(), (int(clean), int(toxic))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", work: Work | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(ids, weights) of the hashed n-grams that matter and the intercept, learnt from labelled rows outside the held-out fold."""
    work = work or Work(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & in_training_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("z"))
    known = work.store(known.where("y = z").select("doc_id", "y"), "known")
    used, ratio, totals = evidence(work.store(feature_counts(docs, known), "feature_counts"))
    sample = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(sample[0].union(sample[1])), "doc_id")  # bounded by MAX_ROWS

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "y": cols["y"], "f": [np.intersect1d(features(t), used, assume_unique=True).tolist() for t in cols["text"]]}

    found = map_rows(rows.select("doc_id", "y", "text"), run, "doc_id long, y int, f array<int>")

    def learn(parts):
        pdf = pd.concat([pd.DataFrame({"doc_id": [], "y": [], "f": []}), *parts]).sort_values("doc_id", kind="stable")
        ids, w, b = fit(pdf["y"].to_numpy().astype(int), [np.asarray(f, dtype=np.int32) for f in pdf["f"]], used, ratio, totals)
        yield pd.DataFrame({"ids": [ids.tolist()], "w": [w.tolist()], "b": [b]})

    model = found.repartition(1).mapInPandas(learn, "ids array<int>, w array<double>, b double").first()
    if model is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0), -50.0
    return np.asarray(model["ids"], dtype=np.int64), np.asarray(model["w"]), model["b"]


def score(docs: DataFrame, ids: np.ndarray, weights: np.ndarray, intercept: float) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        table = np.zeros(1 << BITS)
        table[ids] = weights
        z = []
        for t in cols["text"]:
            h = hashes(t)
            z.append(float(table[np.unique(h[table[h] != 0])].sum()) + intercept)
        return {"doc_id": cols["doc_id"], "score": (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()}

    out = map_rows(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return out.select("doc_id", (~in_training_fold(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
