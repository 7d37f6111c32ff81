"""SimHash near-duplicates by anchor-point covering (operator 9).

A 64-bit fingerprint is cut into blocks of 23, 23 and 18 bits. Two
fingerprints that differ in at most ``4`` bits differ in at most one bit of
some block (three blocks, four bits). In a block the anchors are the code words
of the binary Golay code: a perfect code of length 23 with covering radius 3,
so every block value has exactly one code word within 3 bits, its home (the
18-bit block is padded with zeros). A value one bit away lies within radius
plus one of that home, so a fingerprint also visits every anchor within 4
bits (six at most). Every link therefore meets at an anchor, where homes are
compared with visitors on all 64 bits.

Equal fingerprints are one node, so copies never multiply. The rows of an
anchor are dealt over a grid of cells, finer for anchors with more rows, and a
cell returns only a spanning forest of the links it finds. Components over the
nodes come from ``graph.components``.

Defined cases: a null or empty text has fingerprint zero and is linked like
any other; repeated rows are equal fingerprints; a null ``doc_id`` gets the
component of its fingerprint's other rows (null if there are none); an empty
table gives no rows.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtally.llm.common import Work, ddl_names, map_rows
from wordtally.llm.graph import components, spanning_forest

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: (lowest bit, width) of the blocks.
BLOCKS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
RADIUS = 3
#: Homes or visitors of an anchor that one cell of its grid holds.
CELL_ROWS = 4096


def fingerprint(text: str | None) -> int:
    """SimHash of the 4-word shingles (repeats included) of a whole text, as an unsigned integer."""
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    if len(words) < SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, keep: str = "") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and, on request, more columns (``keep``: their DDL)."""
    more = ddl_names(keep)

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "fp": [_signed(fingerprint(t)) for t in cols["text"]], **{c: cols[c] for c in more}}

    return map_rows(docs.select(*dict.fromkeys(["doc_id", "text", *more])), run, "doc_id long, fp long" + (f", {keep}" if keep else ""))


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit values modulo the generator polynomial."""
    r = values.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where((r >> bit) & 1, r ^ (GOLAY << (bit - 11)), r)
    return r


def _coset_patterns() -> np.ndarray:
    """For each of the 2048 syndromes the error patterns of at most RADIUS + 1 bits, the least first, -1 padded."""
    found: list[list[int]] = [[] for _ in range(2048)]
    pats = np.array([sum(1 << b for b in bits) for w in range(RADIUS + 2) for bits in combinations(range(23), w)], dtype=np.int64)
    for p, s in zip(pats.tolist(), _syndromes(pats).tolist()):
        found[s].append(p)
    out = np.full((2048, max(map(len, found))), -1, dtype=np.int64)
    for s, ps in enumerate(found):
        out[s, : len(ps)] = ps
    return out


def anchors(nodes: DataFrame) -> DataFrame:
    """(fp, anchor, home) rows: the anchors that each fingerprint visits, its home among them."""

    def run(batches):
        patterns = _coset_patterns()
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64)
            parts = []
            for k, (low, width) in enumerate(BLOCKS):
                value = (fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)
                pat = patterns[_syndromes(value)]
                row, col = np.nonzero(pat >= 0)
                code = value[row] ^ pat[row, col]
                parts.append(pd.DataFrame({"fp": fp[row], "anchor": (code << 2) | k, "home": col == 0}))
            yield pd.concat(parts)

    return nodes.mapInPandas(run, "fp long, anchor long, home boolean")


def _compare(h: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int]]:
    """Spanning forest of the links between the homes and the visitors of one cell."""
    a: list[int] = []
    b: list[int] = []
    h, v = np.unique(h), np.unique(v)
    for at in range(0, len(h), 256):
        near = np.bitwise_count(h[at : at + 256, None].view(np.uint64) ^ v[None, :].view(np.uint64)) <= MAX_BITS
        i, j = np.nonzero(near)
        x, y = h[at + i], v[j]
        other = x != y
        a += x[other].tolist()
        b += y[other].tolist()
        if len(a) > 200_000:  # thinned before the next strip is compared
            keep = spanning_forest(a, b)
            a, b = [a[k] for k in keep], [b[k] for k in keep]
    keep = spanning_forest(a, b)
    return [a[k] for k in keep], [b[k] for k in keep]


def _compare_cells(batches):
    """Rows (anchor, hp, vp, home, fp) sorted by cell -> links; a cell may span batches."""
    rest = None
    for batch in chain(batches, [None]):
        pdf = batch if rest is None else rest if batch is None else pd.concat([rest, batch])
        if pdf is None or not len(pdf):
            continue
        key = pdf[["anchor", "hp", "vp"]].to_numpy()
        ends = np.append(np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1, len(key))
        whole = len(ends) if batch is None else len(ends) - 1  # the last cell may go on
        fp, home = pdf["fp"].to_numpy(np.int64), pdf["home"].to_numpy(bool)
        a, b, start = [], [], 0
        for end in ends[:whole]:
            mine = home[start:end]
            if mine.any() and end - start > 1:
                x, y = _compare(fp[start:end][mine], fp[start:end][~mine])
                a += x
                b += y
            start = end
        rest = pdf.iloc[start:]
        yield pd.DataFrame({"a": a, "b": b}, dtype="int64")


def links(nodes: DataFrame, work: Work) -> DataFrame:
    """Links (a, b) between fingerprints of ``nodes`` (fp) that connect all pairs within MAX_BITS."""
    placed = work.store(anchors(nodes), "anchors")
    size = placed.groupBy("anchor").agg(F.sum(F.col("home").cast("long")).alias("h"), F.count(F.lit(1)).alias("v"))
    # an anchor with a home and another fingerprint gets a grid of cells by its own counts
    size = size.where("h > 0 AND v > 1").select("anchor", F.ceil(F.col("h") / CELL_ROWS).alias("hs"), F.ceil(F.col("v") / CELL_ROWS).alias("vs"))
    size = work.store(size, "grid")
    j = placed.join(size, "anchor")
    hp, vp = F.pmod(F.xxhash64("fp"), F.col("hs")), F.pmod(F.xxhash64("fp"), F.col("vs"))
    zero = F.lit(0).cast("long")
    # a home goes to every cell of its row of the grid, a visitor to every cell of its column
    cells = F.when(F.col("home"), F.transform(F.sequence(zero, F.col("vs") - 1), lambda x: F.struct(hp.alias("hp"), x.alias("vp"), F.lit(True).alias("home"))))
    visits = F.transform(F.sequence(zero, F.col("hs") - 1), lambda x: F.struct(x.alias("hp"), vp.alias("vp"), F.lit(False).alias("home")))
    dealt = j.select("anchor", "fp", F.explode(F.concat(F.coalesce(cells, F.slice(visits, 1, 0)), visits)).alias("c")).select("anchor", "c.hp", "c.vp", "c.home", "fp")
    cell = ["anchor", "hp", "vp"]
    return dealt.repartition(*cell).sortWithinPartitions(*cell).mapInPandas(_compare_cells, "a long, b long")


def grouped(f: DataFrame, work: Work) -> DataFrame:
    """Rows with a fingerprint ``fp`` and ``doc_id``, with ``root`` (least linked fp) and ``component_id`` (smallest linked doc_id)."""
    nodes = work.store(f.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    comp = components(links(nodes.select("fp"), work), work)
    node = nodes.join(comp, nodes.fp == comp.node, "left").select(nodes.fp, F.coalesce("root", nodes.fp).alias("root"), "first")
    best = node.groupBy("root").agg(F.min("first").alias("component_id"))
    label = node.join(best, "root").select(F.col("fp").alias("l_fp"), "root", "component_id")
    return f.join(label, f.fp == label.l_fp).drop("l_fp")


def near_duplicates(docs: DataFrame, work: Work) -> DataFrame:
    """doc_id, fp, root and component_id of every document."""
    return grouped(work.store(fingerprints(docs), "fp"), work)


def keep_one(docs: DataFrame, work: Work) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest ``doc_id`` (a null id only if there is no other)."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    f = work.store(fingerprints(whole, f"row {whole.schema['row'].dataType.simpleString()}"), "printed")
    label = grouped(f.select("doc_id", "fp"), work)
    best = label.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")).alias("b"))
    ident = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    best = best.select("b.doc_id", "b.fp").select(ident.alias("w_id"), F.col("fp").alias("w_fp"))
    j = f.withColumn("k_id", ident).join(best, (F.col("k_id") == F.col("w_id")) & (f.fp == F.col("w_fp")))
    # rows that share an id and a fingerprint are joined to one winner; the least of them stays
    return j.groupBy("k_id", "fp").agg(F.min("row").alias("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def hex_digits(fp):
    """16 lowercase hex digits of the 64 bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
