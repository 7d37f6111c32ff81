"""Operators 11 to 13 against plain versions and on edge cases."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from wordtally.llm import lexical, merkle, minhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for doc, c, n in held:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in asked.items() if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scores)[:10])]
    return out


def key(rows):
    return sorted(rows, key=repr)


WORDS = "alpha beta gamma delta épsilon Zeta eta theta iota kappa lambda mu nu xi".split()


@pytest.fixture(scope="module")
def texts():
    """Rows with a hot text, ties, nulls, equal ids, long and punctuated texts."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS, range(14, 0, -1), k=rng.randint(1, 30)))) for i in range(300)]
    rows += [(1000 + i, "alpha beta, xi! xi ÉPSILON") for i in range(60)]
    rows += [(None, "alpha beta, xi! xi ÉPSILON"), (None, None), (7, "again alpha"), (7, "again alpha"), (2000, ""), (2001, "-- ..")]
    return rows + [(2002, "mu nu " * 30_000), (2003, "x" * 100_000 + " alpha2beta")]


def test_search_against_plain(spark, make_docs, work, texts):
    docs = make_docs([(i, t, "en", "s") for i, t in texts]).withColumnRenamed("words", "rank")
    items = [(1, "alpha xi xi"), (1, "alpha xi xi"), (1, "mu"), (2, "nothing known"), (3, None), (4, ""), (5, "ÉPSILON épsilon Alpha2Beta"), (None, "again kappa nu")]
    got = lexical.search(docs, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int"), work)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert key(map(tuple, got.collect())) == key(plain_search(texts, [i for i in items if i[1]]))


def test_search_in_several_blocks(spark, make_docs, work, texts, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 6)
    items = [(i, f"{a} {b}") for i, (a, b) in enumerate(zip(WORDS, WORDS[3:]))]
    got = lexical.search(make_docs([(i, t, "en", "s") for i, t in texts]), spark.createDataFrame(items, "item_id long, text string"), work)
    assert key(map(tuple, got.collect())) == key(plain_search(texts, items))


def test_tree_prunes_and_loses_nothing():
    rng = np.random.default_rng(3)
    n, terms = 5000, 400
    vectors = [np.unique(np.minimum(rng.geometric(0.02, rng.integers(1, 40)) - 1, terms - 1)) for _ in range(n)]
    tfs = [rng.geometric(0.5, len(v)) for v in vectors]
    m = rng.integers(30, 300, n)
    flat = np.concatenate(vectors), np.concatenate(tfs).astype(np.int64)
    tree = lexical.Tree(list(range(n)), m, np.array([len(v) for v in vectors]), *flat, terms)
    scored = 0
    for _ in range(30):
        ranks = np.unique(rng.integers(0, terms, 6))
        weights = rng.integers(1, 3000, len(ranks))
        best = []
        lookup = np.zeros(terms, dtype=np.int64)
        tree.search(ranks, weights, lookup, best)
        assert not lookup.any()
        w = dict(zip(ranks.tolist(), weights.tolist()))
        plain = [(-sum(w.get(t, 0) * ((10**9 * f) // (1000 * f + 8 * int(m[d]))) for t, f in zip(vectors[d].tolist(), tfs[d].tolist())), False, d) for d in range(n)]
        assert best == sorted(p for p in plain if p[0])[:10]
        floor = -best[-1][0]
        bounds = tree.bounds(0, len(tree.lo), ranks, weights)
        leaves = np.array(tree.first) == np.array(tree.last)
        for node in np.nonzero(leaves)[0].tolist():  # a bound never lies below a score in its subtree
            assert bounds[node] >= max(-plain[tree.docs[d]][0] for d in range(tree.lo[node], tree.hi[node]))
        scored += (leaves & (bounds >= floor)).sum() / leaves.sum()
    assert scored / 30 < 0.6  # most leaves are never opened


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""

    def leaf(row, text):
        doc_id, _, lang, source, n_chars = row
        return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))

    def tree(nodes):
        proofs, width = [[] for _ in nodes], 1
        while len(nodes) > 1:
            for at, proof in enumerate(proofs):
                here = at // width
                run = nodes[here // 8 * 8 : here // 8 * 8 + 8]
                proof.append(("".join(run[: here % 8]), "".join(run[here % 8 + 1 :])))
            nodes, width = [sha(nodes[i : i + 8]) for i in range(0, len(nodes), 8)], width * 8
        return nodes[0], proofs

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    for rows_of in by.values():
        rows_of.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    subs = [tree([leaf(r, r[1]) for r in by[lang]]) for lang in langs]
    root, tops = tree([s for s, _ in subs])
    out = []
    for lang, (sub, proofs), top in zip(langs, subs, tops):
        for r, proof in zip(by[lang], proofs):
            full = proof + top
            crc = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 1
            node = leaf(r, r[1].translate(LOWER) if crc % 3 == 0 and r[1] is not None else r[1])
            for before, after in full:
                node = sha([before, node, after])
            out.append((r[0], leaf(r, r[1]), sub, root, sha(s for p in full for s in p), node, node == root))
    return out


@pytest.mark.parametrize("counts", [(1,), (8, 9), (64, 65, 1), (7, 520, 73, 1, 2, 3, 4, 5, 6, 130)])
@pytest.mark.parametrize("levels", [0, 1])
def test_manifest_against_plain(make_docs, work, counts, levels):
    langs = [None, "", *(chr(ord("a") + i) + "é" for i in range(20))]
    rows = [(1000 * k + i, f"Text {i} Ä", lang, f"s{i % 3}") for k, (n, lang) in enumerate(zip(counts, langs)) for i in range(n)]
    got = merkle.manifest(make_docs(rows), work, levels)
    assert key(map(tuple, got.collect())) == key(plain_manifest([(*r, len(r[1])) for r in rows]))


def test_manifest_edge_rows(spark, make_docs, work):
    rows = [(None, "A", "en", None), (None, None, "en", "s"), (3, "", None, "s"), (3, "", None, "s"), (3, "B", None, "s"), (6, "Z" * 200_000, "en", ""), (9, None, "xx", "é")]
    docs = make_docs(rows).withColumnRenamed("words", "leaf").withColumnRenamed("fp", "p")
    want = [(*r, len(r[1] or "")) for r in rows]
    assert key(map(tuple, merkle.manifest(docs, work).collect())) == key(plain_manifest(want))
    assert merkle.manifest(docs.limit(0), work).count() == 0


def plain_groups(rows):
    """(doc_id, n_shingles, component_id, kept) from all pairs of distinct sets."""
    sets = []
    for _, text in rows:
        words = (text or "").translate(LOWER)
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
        sets.append(frozenset([tuple(words)] if 0 < len(words) < 4 else [tuple(words[i : i + 4]) for i in range(len(words) - 3)]))
    distinct = sorted({s for s in sets if s}, key=repr)
    label = {s: i for i, s in enumerate(distinct)}
    for a in distinct:
        for b in distinct:
            if label[a] != label[b] and 100 * len(a & b) >= 80 * len(a | b):
                old = label[b]
                label = {s: label[a] if v == old else v for s, v in label.items()}
    least = {}
    for (doc, _), s in zip(rows, sets):
        if s and doc is not None:
            least[label[s]] = min(doc, least.get(label[s], doc))
    out = []
    for (doc, _), s in zip(rows, sets):
        comp = least.get(label[s]) if s else doc
        out.append((doc, len(s), comp, doc == comp))
    return out


def near_copies(seed, groups=25):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(3, 120))]
        rows.append((len(rows) * 3, " ".join(base)))
        for _ in range(rng.randint(0, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
            rows.append((len(rows) * 3, " ".join(words).upper() if rng.random() < 0.3 else "\t".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell", [2048, 3])
def test_minhash_against_all_pairs(make_docs, work, monkeypatch, cell):
    monkeypatch.setattr(minhash, "CELL_ROWS", cell)  # small cells: buckets and groups are dealt over grids
    rows = near_copies(1) + [(90_001, None), (90_002, ""), (None, " \n"), (90_003, "one two"), (90_004, "One  TWO"), (None, "one two"), (None, "lonely text"), (90_005, "é É"), (90_006, "É É")]
    rows += [(90_010 + i, "the same text that occurs very often in here") for i in range(50)] + [(90_010, "the same text that occurs very often in here")]
    rows += [(91_000, " ".join(f"l{i}" for i in range(40_000))), (91_001, " ".join(f"l{i}" for i in range(42_000)))]
    docs = make_docs([(i, t, "en", "s") for i, t in rows]).withColumnRenamed("words", "node").withColumnRenamed("fp", "bands")
    assert key(map(tuple, minhash.near_duplicates(docs, work).collect())) == key(plain_groups(rows))


def test_minhash_on_nothing(make_docs, work):
    assert minhash.near_duplicates(make_docs([(1, None, "en", "s")]), work).collect() == [(1, 0, 1, True)]
    assert minhash.near_duplicates(make_docs([(1, "a", "en", "s")]).limit(0), work).count() == 0


def test_signature_is_superminhash():
    """The batch form gives what the elements give one by one, and its estimate is unbiased with less variance than independent hashes."""
    rng = np.random.default_rng(0)
    some = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    one_by_one = np.min([minhash.signatures([some[i : i + 1]])[0] for i in range(len(some))], axis=0)
    assert (minhash.signatures([some[:3], some, some[5:9]])[1] == one_by_one).all()
    alone = minhash.signatures([some[:1]])[0]
    assert sorted((alone >> np.uint64(32)).tolist()) == list(range(minhash.SLOTS))  # a permutation
    shares = []
    for _ in range(200):
        u = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
        a, b = minhash.signatures([u[:18], u[2:]])
        shares.append((a == b).mean())
    assert abs(np.mean(shares) - 0.8) < 0.01
    assert np.std(shares) < 0.85 * math.sqrt(0.16 / minhash.SLOTS)
