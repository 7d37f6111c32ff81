"""Packing documents into windows of 2048 tokens by non-negative least squares (operator 3).

1. Each document is tokenized once, on the executors. What fills whole windows
   is cut off; the rest is an item whose class is its length. An item carries
   the CRC of its ids and the CRCs before and after every 64th id, so that a
   later cut needs no second tokenization.
2. The histogram of classes (2048 counts at most, whatever the input) goes to
   the driver. Shallow combinations of lengths that fill a window exactly are
   enumerated, non-negative least squares finds how often to repeat each, and
   the rounded counts are used as far as the histogram allows. What is left is
   packed greedily, largest first; a gap no item fits is filled by cutting one.
3. The plan assigns ranges of ranks within a class to sequences. Ranks are the
   running number of an item in its partition plus the counts of the partitions
   before, so no class, however frequent, is sorted or gathered in one task.

Defined cases: a null or empty text is one closing id; repeated rows are packed
one by one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wordtally.llm.common import Work

WINDOW = 2048
END_ID = 1
#: Items may be cut at multiples of this many ids, once.
GRID = 64
#: Lengths, the most frequent ones, that three-part combinations are built from.
SUPPORT = 64
STEPS = 400
#: Entries of a worker's memo of words; it is emptied when full.
MEMO_ROWS = 500_000
_MARKS = re.compile(r"[.,;:!?%|$&#*)\]}\"]+\Z")


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space, remembered by word.

    Its normalizer and splitter never look across white space, so a text's ids
    are those of its words one after the other. A run of ASCII marks after a
    letter or digit is a piece of its own, and ASCII letters are lower-cased,
    so words are remembered without either.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that end a piece
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {"": b""}

    def learn(self, new: set[str]) -> None:
        """Remember the ids of words not met before."""
        memo = self.memo
        parts: dict[str, tuple[str, str]] = {}
        letters: dict[str, None] = {}
        others: dict[str, None] = {}
        for w in new:
            body, tail = w.lower() if w.isascii() else w, ""
            m = None if body[-1:].isalnum() else _MARKS.search(body)
            if m and m.start() and "'" not in body and normalize("NFC", body[m.start() - 1]).lower()[-1].isalnum():
                body, tail = body[: m.start()], body[m.start() :]
            parts[w] = body, tail
            for x in (body, tail):
                if x not in memo:
                    (letters if x.isalpha() and "\u0130" not in x and is_normalized("NFC", x) else others)[x] = None
        if letters:  # each of these is one piece, so they go through the tokenizer as one text
            e = self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0]
            ids = np.array(e.ids, dtype="<u4")
            ends = (np.nonzero(self.closes[ids])[0] + 1).tolist()
            start, raw = 0, ids.tobytes()
            for x, end in zip(letters, ends, strict=True):
                memo[x] = raw[4 * start : 4 * end]
                start = end
        for x, e in zip(others, self.tokenizer.encode_batch_fast(list(others), add_special_tokens=False)):
            memo[x] = np.array(e.ids, dtype="<u4").tobytes()
        for w, (body, tail) in parts.items():
            memo[w] = memo[body] + memo[tail]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text and the closing id, as little-endian unsigned 32-bit integers."""
        memo, out, end = self.memo, [], END_ID.to_bytes(4, "little")
        for at in range(0, len(texts), 32):
            words = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts[at : at + 32]]
            if len(memo) > MEMO_ROWS:
                memo.clear()
                memo[""] = b""
            found = [list(map(memo.get, w)) for w in words]
            new = [[i for i, x in enumerate(ids) if x is None] for ids in found]
            self.learn({w[i] for w, places in zip(words, new) for i in places})
            for w, ids, places in zip(words, found, new):
                for i in places:
                    ids[i] = memo[w[i]]
                out.append(b"".join(ids) + end)
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


_ITEM = pa.schema([
    ("part", pa.int64()), ("cls", pa.int64()), ("idx", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()),
    ("crc", pa.int64()), ("heads", pa.list_(pa.int64())), ("tails", pa.list_(pa.int64())),
])


def items(docs: DataFrame, path: str) -> DataFrame:
    """Whole windows (class 2048) and rests of every document, numbered within partition and class."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256).to_pydict()
                rows = []
                for doc, ids in zip(piece["doc_id"], tokenizer(path).encode(piece["text"])):
                    n = len(ids) // 4
                    for start in range(0, n, WINDOW):
                        x = ids[4 * start : 4 * (start + WINDOW)]
                        cls = len(x) // 4
                        cuts = range(4 * GRID, len(x), 4 * GRID) if cls < WINDOW else ()
                        heads, crc = [], 0
                        for c in cuts:
                            crc = zlib.crc32(x[c - 4 * GRID : c], crc)
                            heads.append(crc)
                        rows.append((part, cls, seen[cls], doc, start, n, zlib.crc32(x), heads, [zlib.crc32(x[c:]) for c in cuts]))
                        seen[cls] += 1
                cols = list(zip(*rows)) if rows else [()] * len(_ITEM)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _ITEM)], schema=_ITEM)

    ddl = "part long, cls long, idx long, doc_id long, start long, doc_tokens long, crc long, heads array<long>, tails array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def combinations(hist: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a window and occur in the histogram."""
    have = np.nonzero(hist)[0]
    pairs = [(a, WINDOW - a, 0) for a in have.tolist() if a <= WINDOW // 2 and hist[WINDOW - a]]
    top = np.sort(have[np.argsort(-hist[have], kind="stable")[:SUPPORT]]).tolist()
    triples = {tuple(sorted((a, b, c))) for i, a in enumerate(top) for b in top[i:] if 0 < (c := WINDOW - a - b) < WINDOW and hist[c]}
    return np.array(pairs + sorted(triples), dtype=np.int64).reshape(-1, 3)


def repeat_counts(combos: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """How often to use each combination: non-negative least squares by accelerated projected gradients."""
    want = hist.astype(float)
    want[0] = 0

    def cover(x):
        out = np.zeros(WINDOW + 1)
        for k in range(3):
            out += np.bincount(combos[:, k], weights=x, minlength=WINDOW + 1)
        out[0] = 0
        return out

    v = np.ones(len(combos))
    for _ in range(30):
        u = cover(v)[combos].sum(axis=1)
        bound = np.linalg.norm(u) / np.linalg.norm(v)
        v = u / np.linalg.norm(u)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(0, y - (cover(y) - want)[combos].sum(axis=1) / (1.1 * bound))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


class Plan:
    """Ranges of ranks of each class and the sequences they go to."""

    def __init__(self, hist: np.ndarray):
        #: class -> ranges (original class, first rank, count, first id within the item), whole items and tails of cut ones
        self.whole = {int(c): [(int(c), 0, int(hist[c]), 0)] for c in np.nonzero(hist)[0]}
        self.tails: dict[int, list] = defaultdict(list)
        self.left = hist.astype(np.int64).copy()
        self.uncut = self.left.copy()
        self.rows: list[tuple[int, ...]] = []
        self.sequences = 0

    def take(self, cls: int, n: int, whole_only: bool = False) -> list[tuple[int, int, int, int]]:
        out = []
        self.left[cls] -= n
        while n:
            pool = self.whole if whole_only or not self.tails[cls] else self.tails
            orig, rank, have, begin = pool[cls].pop()
            use = min(n, have)
            out.append((orig, rank, use, begin))
            if have > use:
                pool[cls].append((orig, rank + use, have - use, begin))
            if pool is self.whole:
                self.uncut[cls] -= use
            n -= use
        return out

    def place(self, ranges: list[tuple[int, int, int, int]], length: int, offset: int) -> None:
        seq = self.sequences
        for orig, rank, n, begin in ranges:
            self.rows.append((orig, rank, rank + n, begin, length, seq - rank, offset))
            seq += n

    def use(self, lengths: list[int], times: int, cut: tuple[int, int] | None = None) -> None:
        """``times`` sequences of these lengths, and at their end the first ids of an item of class ``cut[0]``."""
        offset = 0
        for c in lengths:
            self.place(self.take(c, times), c, offset)
            offset += c
        if cut:
            cls, head = cut
            ranges = self.take(cls, times, whole_only=True)
            self.place(ranges, head, offset)
            for orig, rank, n, _ in ranges:
                self.tails[cls - head].append((orig, rank, n, head))
            self.left[cls - head] += times
        self.sequences += times

    def greedy(self) -> None:
        while self.left.any():
            lengths, gap = [], WINDOW
            free = self.left.copy()
            while gap:
                fits = np.nonzero(free[: gap + 1])[0]
                if not len(fits):
                    break
                c = int(fits[-1])
                n = min(int(free[c]), gap // c)
                lengths += [c] * n
                free[c] -= n
                gap -= n * c
            counts = {c: lengths.count(c) for c in set(lengths)}
            times = min(int(self.left[c]) // k for c, k in counts.items())
            cut = None
            head = gap // GRID * GRID
            if head:
                # a class that the pattern uses too must have one more uncut item for each sequence
                room = np.array([self.uncut[c] // (counts.get(c, 0) + 1) for c in range(gap + 1, WINDOW)], dtype=np.int64)
                larger = np.nonzero(room)[0]
                if len(larger):
                    cls = int(larger[0]) + gap + 1
                    times = min(times, int(room[larger[0]]))
                    cut = cls, head
            self.use(lengths, times, cut)


def plan(hist: np.ndarray) -> list[tuple[int, ...]]:
    """Rows (class, first rank, end rank, first id, length, sequence minus rank, offset)."""
    p = Plan(hist)
    if hist[WINDOW]:
        p.use([WINDOW], int(hist[WINDOW]))
    rest = p.left.copy()
    combos = combinations(rest)
    if len(combos):
        x = repeat_counts(combos, rest)
        for k in np.argsort(-x, kind="stable"):
            lengths = [int(c) for c in combos[k] if c]
            need = {c: lengths.count(c) for c in lengths}
            times = min(int(x[k] + 0.5), *(int(p.left[c]) // m for c, m in need.items()))
            if times > 0:
                p.use(lengths, times)
    p.greedy()
    return p.rows


_PLAN = StructType([StructField(n, LongType(), False) for n in ("p_cls", "p_from", "p_to", "p_begin", "p_length", "p_shift", "p_offset")])


def pack(docs: DataFrame, work: Work, path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    it = work.store(items(docs, path), "items")
    counts = it.groupBy("part", "cls").agg(F.count(F.lit(1)).alias("n"))
    counts = work.store(counts, "counts")
    hist = np.zeros(WINDOW + 1, dtype=np.int64)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect():  # 2048 rows at most
        hist[r["cls"]] = r["n"]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("part", "cls", before.alias("base"))
    ranked = it.join(base, ["part", "cls"]).withColumn("rank", F.col("idx") + F.col("base"))
    rows = F.broadcast(spark.createDataFrame(plan(hist), _PLAN))  # bounded by the number of lengths, not by the input
    j = ranked.join(rows, (F.col("cls") == F.col("p_cls")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to")))
    crc = (
        F.when(F.col("p_length") == F.col("cls"), F.col("crc"))
        .when(F.col("p_begin") == 0, F.expr(f"element_at(heads, CAST(p_length DIV {GRID} AS INT))"))
        .otherwise(F.expr(f"element_at(tails, CAST(p_begin DIV {GRID} AS INT))"))
    )
    return j.select(
        "doc_id", (F.col("start") + F.col("p_begin")).alias("start"), F.col("p_length").alias("length"), crc.alias("ids_crc32"),
        "doc_tokens", (F.col("rank") + F.col("p_shift")).alias("sequence_id"), F.col("p_offset").alias("offset"),
    )
