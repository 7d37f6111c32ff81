"""Quality by positive-unlabelled learning (operator 5).

Only trusted positives (quality 1, outside the held-out fold) and unlabelled
web text are used; negative labels are never looked at. Each whole text is
described by its shape (word lengths, marks, case, repetition, lines), the
measures are cut into quantile bins of the sample, and a linear score is
trained to minimise the non-negative unbiased risk

    prior * risk+(positives) + max(0, risk-(unlabelled) - prior * risk-(positives)).

The class prior is estimated from the two samples: a first classifier tells
positives from unlabelled text, and the prior is the least ratio, over score
thresholds, of the share of unlabelled text above it to the share of positives
above it (with a confidence margin for small shares).

The samples hold at most ``MAX_ROWS`` rows each (least hash of ``doc_id``) and
are fitted in one task; the model is a small vector.

Defined cases: a null or empty text has all measures zero; null labels are
unlabelled; without positives every score is 0; repeated rows are scored one by
one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtally.llm.common import Work, in_training_fold, map_rows

#: Rows of each sample, at most.
MAX_ROWS = 12_000
BINS = 16
STEPS = 600
RIDGE = 1e-4
#: Factor on the first classifier's log ratio as the starting score.
SHARPEN = 3.0
THRESHOLD = 0.3
_MARKS = "!?.,;:|#*$%&<>()\"'"
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
N_FEATURES = 14 + len(_MARKS)


def measures(text: str | None) -> list[float]:
    """Shape of a whole text."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    chars = int(size.sum())
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = list(zip(words, words[1:]))
    top = Counter(words).most_common(1)[0][1]
    same = sum(map(str.__eq__, words, words[1:]))
    upper = len(_UPPER.findall(text))
    out = [
        np.log1p(n), chars / n, float(size.std()), float((size <= 3).mean()), float((size >= 12).mean()),
        len(distinct) / n, top / n, same / n, len(set(pairs)) / max(1, len(pairs)),
        len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), upper / chars, upper / n, len(_DIGIT.findall(text)) / chars,
    ]
    return [float(x) for x in out] + [text.count(c) / n for c in _MARKS]


def described(docs: DataFrame) -> DataFrame:
    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "x": [measures(t) for t in cols["text"]]}

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, x array<float>")


def design(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """One column per quantile bin border that a measure lies above, and a constant."""
    parts = [(x[:, [k]] > c[None, :]) for k, c in enumerate(cuts)]
    return np.concatenate([*parts, np.ones((len(x), 1), dtype=bool)], axis=1).astype(np.float32)


def _descend(a: np.ndarray, slope, steps: int = STEPS, start: np.ndarray | None = None) -> np.ndarray:
    """Adam on the gradient ``a' slope(a w)`` with a ridge."""
    w = np.zeros(a.shape[1]) if start is None else start
    m, v = np.zeros(a.shape[1]), np.zeros(a.shape[1])
    for step in range(1, steps + 1):
        g = a.T @ slope(a @ w).astype(np.float32) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in unlabelled text: ratio of the shares above a score, where its upper confidence bound is least."""
    margin = np.sqrt(np.log(40) / (2 * len(pos))) + np.sqrt(np.log(40) / (2 * len(unl)))
    found = []
    for t in np.unique(np.quantile(pos, np.linspace(0, 0.99, 100))):
        p, u = (pos >= t).mean(), (unl >= t).mean()
        found.append(((u + margin) / p, u / p))
    return float(min(max(min(found)[1], 0.01), 0.99))


def fit(pos: np.ndarray, unl: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """(bin borders, weights, class prior) from the measures of positives and of unlabelled text."""
    both = np.concatenate([pos, unl])
    cuts = [np.unique(np.quantile(both[:, k], np.linspace(0, 1, BINS + 1)[:-1])) for k in range(both.shape[1])]
    a = design(both, cuts)
    p = np.arange(len(both)) < len(pos)
    n_p, n_u = max(1, int(p.sum())), max(1, int((~p).sum()))
    share = np.where(p, 1 / n_p, 1 / n_u) / 2
    # positives against unlabelled text, fitted on one half and used on the other
    odd = np.arange(len(both)) % 2 == 1
    raw, start = np.zeros(len(both)), np.zeros(a.shape[1])
    for half in (odd, ~odd):
        w = _descend(a[half], lambda z, h=half: share[h] * 2 * (_sigmoid(z) - p[h]), 200)
        raw[~half] = a[~half] @ w
        start += w / 2
    prior = class_prior(raw[p], raw[~p])
    # a text is as likely positive as not where the ratio of the densities is 1 / (2 prior): training starts there
    start[-1] += np.log(2 * prior)
    start *= SHARPEN

    def slope(z: np.ndarray) -> np.ndarray:
        s = _sigmoid(z)
        d = s * (1 - s)
        # sigmoid losses: 1 - s for the positive class, s for the negative one
        negative = s[~p].mean() - prior * s[p].mean()
        g = np.zeros(len(z))
        if negative >= 0:
            g[p] = -2 * prior * d[p] / n_p
            g[~p] = d[~p] / n_u
        else:  # the estimate went below zero: step back on it
            g[p] = prior * d[p] / n_p
            g[~p] = -d[~p] / n_u
        return g

    return cuts, _descend(a, slope, start=start), prior


def train(x: DataFrame, labels: DataFrame):
    """(bin borders, weights, prior) or None without positives; ``x`` has doc_id and the measures."""
    fold = in_training_fold(F.col("doc_id"))
    known = labels.where((F.col("quality") == 1) & fold).select("doc_id").distinct()
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    pos = known.orderBy(*by_hash).limit(MAX_ROWS)
    unl = x.where(fold).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(MAX_ROWS)
    tagged = F.broadcast(pos.withColumn("trusted", F.lit(True)).union(unl.withColumn("trusted", F.lit(False))))  # bounded by MAX_ROWS
    sample = x.join(tagged, "doc_id").select("doc_id", "trusted", "x")

    def learn(parts):
        pdf = pd.concat([pd.DataFrame({"doc_id": [], "trusted": [], "x": []}), *parts]).sort_values("doc_id", kind="stable")
        sides = [pdf[pdf["trusted"].astype(bool) == side]["x"].tolist() for side in (True, False)]
        if sides[0] and sides[1]:
            cuts, w, prior = fit(*(np.stack(s).astype(float) for s in sides))
            yield pd.DataFrame({"cuts": [[c.tolist() for c in cuts]], "w": [w.tolist()], "prior": [prior]})

    row = sample.repartition(1).mapInPandas(learn, "cuts array<array<double>>, w array<double>, prior double").first()
    return row and ([np.array(c) for c in row["cuts"]], np.array(row["w"]), row["prior"])


def score(docs: DataFrame, labels: DataFrame, work: Work) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    x = work.store(described(docs), "measures")
    model = train(x, labels)

    def run(cols: dict[str, list]) -> dict[str, list]:
        n = len(cols["doc_id"])
        z = np.full(n, -50.0)
        if model and n:
            z = design(np.array(cols["x"], dtype=np.float32).astype(float), model[0]) @ model[1]
        return {"doc_id": cols["doc_id"], "score": _sigmoid(z).tolist()}

    out = map_rows(x, run, "doc_id long, score double", rows=4096)
    return out.select("doc_id", (~in_training_fold(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
