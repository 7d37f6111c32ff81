"""Substring deduplication over words with FM-indexes (operator 6).

A word is removed if some window of 20 consecutive words that covers it starts
earlier somewhere (smaller document, or same document and earlier start).

1. Every window has a minimizer: the least hash among its 3-word grams.
   Consecutive windows with one minimizer form a segment, so equal windows lie
   in segments with equal minimizers. Of the 17 words that a window has beside
   its minimizer at least 9 lie on one side, so equal windows also share the
   minimizer with the 9 words before it, or with the 9 words after it. These
   two runs of 12 words are counted for every segment, and segments of which
   neither occurs twice drop out (by a bit table, which lets through some more).
2. Equal segments are aggregated to one row with its first place and count;
   copies, however many, cost one row from here on.
3. Segments are dealt to shards by minimizer. Each shard builds a compressed
   FM-index of its segments and streams them through it: backward search over
   a wavelet tree gives matching statistics, intervals of 20 words or more that
   occur elsewhere are reported, each with its earliest place.
4. Reports go back to every occurrence of their segment by an equi-join, and
   from there to the documents.

A minimizer with very many segments is split: its windows become segments of
their own, keyed by the whole window, aggregated again, and indexed like the
others, so no shard depends on the size of a group.

Words are compared by 64-bit hashes when segments are grouped and as words in
the index. Defined cases: a null or empty text has no words; texts shorter than a window lose
nothing; a null ``doc_id`` comes after all others; rows with one ``doc_id`` are
one place (equal positions are not earlier than each other), but a cut goes only
to rows with the text it was found in (told apart by a 64-bit hash of the text
where an id is not one row's alone); an empty table gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtally.llm.common import Work, bit_table, ddl_names, in_bit_table, map_rows, sha256_hex
from wordtally.llm.fm_index import FMIndex

WINDOW = 20
GRAM = 3
#: Words that every window has on one side of its minimizer, at least.
SIDE = (WINDOW - GRAM + 1) // 2
#: Tokens of one shard's index, about.
SHARD_TOKENS = 250_000
#: Different segments of a minimizer beyond which its windows are keyed one by one: as many as fill a shard.
HOT_ROWS = SHARD_TOKENS // 28
#: Ids of several rows that are broadcast, at most; beyond, every row is told apart by its text.
REPEATED_IDS = 200_000
_NO_ID = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _key(doc_id):
    return F.coalesce(doc_id, F.lit(_NO_ID))


def repeated_ids(docs: DataFrame, work: Work) -> DataFrame | None:
    """(r_doc): the ids that several rows have; None if they are too many to broadcast."""
    per = docs.groupBy(_key(F.col("doc_id")).alias("r_doc")).agg(F.count(F.lit(1)).alias("n"))
    repeated = work.store(per.where("n > 1").select("r_doc"), "repeated_ids")
    return repeated if repeated.count() <= REPEATED_IDS else None


def placed(docs: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """``docs`` with their place: c_doc, and c_part, which is 0 for the only row of an id and else a hash of the text."""
    d = docs.withColumn("c_doc", _key(F.col("doc_id")))
    text = F.xxhash64("text")
    if repeated is None:
        return d.withColumn("c_part", text)
    j = d.join(F.broadcast(repeated), F.col("c_doc") == F.col("r_doc"), "left")  # at most REPEATED_IDS rows
    return j.withColumn("c_part", F.when(F.col("r_doc").isNull(), F.lit(0)).otherwise(text).cast("long")).drop("r_doc")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, inverse))


class _Hasher:
    """Hashes of any runs of a word-hash array, from prefix sums of a polynomial modulo 2^64."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, h: np.ndarray):
        if len(h) >= len(_Hasher.up):
            _Hasher.up, _Hasher.down = _powers(2 * len(h) + 1024)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _Hasher.up[: len(h)], dtype=np.uint64)])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * _Hasher.down[start]
        x ^= x >> np.uint64(29)
        return x * _BASE


def segments(h: np.ndarray) -> tuple[np.ndarray, ...]:
    """(minimizer hash, content hash, start, length, before, after) of the segments of a document's word hashes.

    ``before`` and ``after`` are the hashes of the minimizer with SIDE words on
    that side (the other side's where the text has fewer words there)."""
    n = len(h)
    if n < WINDOW:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z, z, z
    hasher = _Hasher(h)
    at = np.arange(n - GRAM + 1)
    grams = hasher.runs(at, at + GRAM)
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    span = WINDOW - GRAM + 1
    least = np.arange(n - WINDOW + 1) + np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)
    first = np.concatenate([[0], np.nonzero(least[1:] != least[:-1])[0] + 1])
    last = np.append(first[1:], len(least))
    end = last - 1 + WINDOW
    at = least[first]
    left, right = at >= SIDE, at + GRAM + SIDE <= n  # one of them holds, as a window lies around
    before = hasher.runs(np.where(left, at - SIDE, at), np.where(left, at + GRAM, at + GRAM + SIDE))
    after = hasher.runs(np.where(right, at, at - SIDE), np.where(right, at + GRAM + SIDE, at + GRAM))
    return grams[at].view(np.int64), hasher.runs(first, end).view(np.int64), first, end - first, before.view(np.int64), after.view(np.int64)


def occurrences(docs: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """Every segment of every document: (mini, content, doc, part, start, len, before, after)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for doc, which, text in zip(part.column("c_doc").to_pylist(), part.column("c_part").to_pylist(), part.column("text").to_pylist()):
                    if text:
                        m, c, s, length, b, a = segments(word_hashes(text.encode().split()))
                        out.append((m, c, np.full(len(m), doc, dtype=np.int64), np.full(len(m), which, dtype=np.int64), s, length, b, a))
                if out:
                    m, c, d, w, s, n, b, a = (np.concatenate(x) for x in zip(*out))
                    cols = [pa.array(x) for x in (m, c, d, w, s.astype(np.int32), n.astype(np.int32), b, a)]
                    yield pa.RecordBatch.from_arrays(cols, ["mini", "content", "doc", "part", "start", "len", "before", "after"])

    need = placed(docs.select("doc_id", "text"), repeated).select("c_doc", "c_part", "text")
    return need.mapInArrow(run, "mini long, content long, doc long, part long, start int, len int, before long, after long")


def repeated_sides(occ: DataFrame, work: Work) -> DataFrame:
    """The segments of which the minimizer with the words before it, or with those after it, occurs twice (and a few others)."""
    sides = occ.select(F.explode(F.array_distinct(F.array("before", "after"))).alias("side"))
    twice = work.store(sides.groupBy("side").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("side"), "sides")
    table = occ.sparkSession.sparkContext.broadcast(bit_table(twice, "side"))

    def run(batches):
        for batch in batches:
            seen = in_bit_table(table.value, batch["before"].to_numpy()) | in_bit_table(table.value, batch["after"].to_numpy())
            yield batch.filter(pa.array(seen)).select(["mini", "content", "doc", "part", "start", "len"])

    return occ.mapInArrow(run, "mini long, content long, doc long, part long, start int, len int")


def _cut(docs: DataFrame, wanted: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """The words of the wanted segments, fetched from the document of their first place; a hot one is cut into its windows."""
    lists = wanted.groupBy("doc", "part").agg(F.collect_list(F.struct("mini", "content", "start", "len", "n", "hot")).alias("parts"))  # segments of one text
    need = placed(docs.select("doc_id", "text"), repeated).select(F.col("c_doc").alias("doc"), F.col("c_part").alias("part"), "text")
    j = need.join(lists, ["doc", "part"])

    def run(batches):
        names = ["key", "mini", "content", "off", "doc", "start", "n", "hot", "words"]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                part = batch.slice(at, 64).to_pydict()
                for doc, text, parts in zip(part["doc"], part["text"], part["parts"]):
                    words = (text or "").encode().split()
                    begin = np.array([p["start"] for p in parts], dtype=np.int64)
                    end = begin + np.array([p["len"] for p in parts], dtype=np.int64)
                    inside = end <= len(words)
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, begin[inside], 1)
                    np.add.at(edge, end[inside], -1)
                    used = np.nonzero(np.cumsum(edge)[:-1])[0]
                    h = np.zeros(len(words), dtype=np.uint64)  # only the words of wanted segments are hashed again
                    h[used] = word_hashes([words[i] for i in used.tolist()])
                    hasher = _Hasher(h)
                    content = hasher.runs(np.where(inside, begin, 0), np.where(inside, end, 0)).view(np.int64).tolist()
                    for p, s, e, ok, c in zip(parts, begin.tolist(), end.tolist(), inside.tolist(), content):
                        if not ok or c != p["content"]:
                            continue  # another text with this id and hash
                        if p["hot"]:
                            w = np.arange(s, e - WINDOW + 1)
                            for o, k in enumerate(hasher.runs(w, w + WINDOW).view(np.int64).tolist()):
                                rows.append((k, p["mini"], p["content"], o, doc, s + o, p["n"], True, b" ".join(words[s + o : s + o + WINDOW])))
                        else:
                            rows.append((p["mini"], p["mini"], p["content"], 0, doc, s, p["n"], False, b" ".join(words[s:e])))
                cols = list(zip(*rows)) if rows else [()] * len(names)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)

    return j.mapInArrow(run, "key long, mini long, content long, off int, doc long, start int, n long, hot boolean, words binary")


def index_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Index the segments of a shard, stream them through the index, report windows that occur elsewhere or more than once.

    Rows: key, content, doc, start (first place), n (occurrences), words.
    Result: key, content, and lists of (off, doc0, start0): window and its earliest place.
    """
    pdf = pdf.drop_duplicates(["key", "content"])
    lists = [w.split(b" ") for w in pdf["words"]]
    length = np.array([len(w) for w in lists], dtype=np.int64)
    code: dict[bytes, int] = {}
    flat = np.zeros(int(length.sum()) + len(lists), dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(length + 1)[:-1]]).astype(np.int64)
    for s, w in zip(start.tolist(), lists):
        flat[s : s + len(w)] = [code.setdefault(x, len(code) + 1) for x in w]
    index = FMIndex(flat, WINDOW)
    ms, where = index.matching_statistics(start, length, 2)
    # every window of every segment, its first place and how often the segment occurs
    count = length - WINDOW + 1
    seg = np.repeat(np.arange(len(lists)), count)
    off = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    at = start[seg] + off
    doc = pdf["doc"].to_numpy(np.int64)[seg]
    pos = pdf["start"].to_numpy(np.int64)[seg] + off
    n = pdf["n"].to_numpy(np.int64)
    place = np.empty(len(seg), dtype=np.int64)
    order = np.lexsort((pos, doc))
    place[order] = np.arange(len(seg))
    # the earliest place within the interval of each reported match
    by_text = np.full(len(flat), len(seg), dtype=np.int64)
    by_text[at] = place
    group = index.left[WINDOW]
    heads = np.unique(group)
    least = np.minimum.reduceat(by_text[index.sa], heads)
    hit = ms[at] >= WINDOW
    best = place.copy()
    best[hit] = least[np.searchsorted(heads, group[where[at[hit]]])]
    keep = (best != place) | (n[seg] > 1)
    seg, off = seg[keep], off[keep]
    first = order[best[keep]]
    return pd.DataFrame({
        "key": pdf["key"].to_numpy(np.int64)[seg], "content": pdf["content"].to_numpy(np.int64)[seg],
        "off": off.astype(np.int32), "doc0": doc[first], "start0": pos[first].astype(np.int32),
    })


def _reports(rows: DataFrame, n_rows: int, width: int) -> DataFrame:
    shards = max(1, -(-n_rows * width // SHARD_TOKENS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(lambda pdf: index_shard(pdf), "key long, content long, off int, doc0 long, start0 int")


def removals(docs: DataFrame, work: Work, repeated: DataFrame | None) -> DataFrame:
    """(doc, part, cuts): for each place that loses words, the starts of its windows that occur earlier."""
    occ = work.store(occurrences(docs, repeated), "occ")
    cand = work.store(repeated_sides(occ, work), "cand")
    work.drop("occ")
    work.drop("sides")
    first = cand.groupBy("mini", "content").agg(F.min(F.struct("doc", "start", "len", "part")).alias("f"), F.count(F.lit(1)).alias("n"))
    first = work.store(first, "first")
    # stored, so that the join below shuffles both sides plainly and a frequent minimizer can be split
    times = work.store(first.groupBy("mini").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("times")).where("times > 1"), "times")
    wanted = first.join(times, "mini").select("mini", "content", "f.doc", "f.part", "f.start", "f.len", "n", (F.col("rows") > HOT_ROWS).alias("hot"))
    parts = work.store(_cut(docs, wanted, repeated), "parts")
    work.drop("first")
    work.drop("times")
    plain = parts.where("NOT hot")
    seen = _reports(plain.select("key", "content", "doc", "start", "n", "words"), plain.count(), 28)
    seen = seen.withColumnRenamed("key", "mini")
    # windows of hot minimizers: one row per distinct window, then indexed like segments
    hot = parts.where("hot")
    one = hot.groupBy("key").agg(F.min(F.struct("doc", "start", "words")).alias("f"), F.sum("n").alias("n"))
    one = work.store(one.select("key", F.col("key").alias("content"), "f.doc", "f.start", "n", "f.words"), "windows")
    back = _reports(one, one.count(), WINDOW + 1).select(F.col("key").alias("k"), "doc0", "start0")
    hot_seen = hot.join(back, hot.key == back.k).select("mini", "content", "off", "doc0", "start0")
    lists = seen.select("mini", "content", "off", "doc0", "start0").union(hot_seen)
    lists = lists.groupBy("mini", "content").agg(F.collect_list(F.struct("off", "doc0", "start0")).alias("w"))  # a segment has 18 windows at most
    lists = work.store(lists, "reports")
    work.drop("parts")
    work.drop("windows")
    j = cand.select("mini", "content", "doc", "part", "start").join(lists, ["mini", "content"])
    cuts = j.select("doc", "part", F.expr("transform(filter(w, x -> x.doc0 < doc OR (x.doc0 = doc AND x.start0 < start + x.off)), x -> start + x.off)").alias("c"))
    cuts = work.store(cuts.where("size(c) > 0").groupBy("doc", "part").agg(F.array_distinct(F.flatten(F.collect_list("c"))).alias("cuts")), "cuts")  # windows of one text
    work.drop("cand")
    work.drop("reports")
    return cuts


def kept_words(text: str | None, cuts: list[int] | None) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by one space) of a whole text whose windows at ``cuts`` go."""
    words = (text or "").encode().split()
    n = len(words)
    if not cuts:
        return n, 0, b" ".join(words)
    edge = np.zeros(n + WINDOW + 1, dtype=np.int64)
    at = np.unique(np.asarray(cuts, dtype=np.int64))
    at = at[at + WINDOW <= n]
    edge[at] += 1
    edge[at + WINDOW] -= 1
    gone = np.cumsum(edge)[:n] > 0
    return n, int(gone.sum()), b" ".join(compress(words, (~gone).tolist()))


def deduplicate(docs: DataFrame, work: Work, keep: str = "", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text, and the ``keep`` columns) of every document."""
    more = ddl_names(keep)
    repeated = repeated_ids(docs, work)
    cuts = removals(docs, work, repeated).withColumnsRenamed({"doc": "c_doc", "part": "c_part"})
    need = placed(docs.select(*dict.fromkeys(["doc_id", "text", *more])), repeated)
    j = need.join(cuts, ["c_doc", "c_part"], "left").drop("c_doc", "c_part")

    def run(cols: dict[str, list]) -> dict[str, list]:
        rows = [kept_words(t, c) for t, c in zip(cols["text"], cols["cuts"])]
        out = {"doc_id": cols["doc_id"], "n_words": [r[0] for r in rows], "n_removed": [r[1] for r in rows], "kept_sha256": [sha256_hex(r[2]) for r in rows], **{c: cols[c] for c in more}}
        if with_text:
            out["kept_text"] = [r[2].decode() for r in rows]
        return out

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (f", {keep}" if keep else "") + (", kept_text string" if with_text else "")
    return map_rows(j, run, schema, rows=128)
