"""Brute-force checks and edge cases of the operators on texts."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
EDGE = [
    (1, None, "en", "a"), (2, "", None, None), (3, "one", "en", "a"), (4, LONG, "en", "a"), (4, LONG, "en", "a"),
    (None, "null id text of a few words", "de", None), (6, "  \n\t ", "en", "b"), (7, "a\x85b\xa0c x\x1cy", "en", "b"), (8, "!" * 5000, "fr", "b"),
]


def passage(seed, n):
    r = random.Random(seed)
    return [f"{r.choice('abcdefgh')}{r.randint(0, 400)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    out, shared = list(EDGE), passage("p", 60)
    for i in range(10, 60):
        w = passage(i, 120)
        if i % 3 == 0:
            w[20:20] = shared
        if i % 7 == 0:
            w = passage(i - 7, 120)
        if i % 11 == 0:
            w[60] = "changed"
        out.append((i, " ".join(w), "en", f"s{i % 2}"))
    return out


def test_quality_measures(make_docs, work, rows):
    from wordtally.llm import quality_rules as Q

    text = "a b c\na b c\n\nx ## y\na b c"
    assert Q.measure(text) == (12, 13, 2, 2, 9)
    assert Q.measure("a b a b a") == (5, 5, 0, 0, 5)
    out = Q.judge(make_docs(rows), work).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert all(r.kept for r in out if r.doc_id and r.doc_id >= 10)


def test_quality_buckets(spark):
    from wordtally.llm.common import bucket_of

    for v, b in spark.range(0, 70_000, 37).select("id", bucket_of("id").alias("b")).collect():
        assert b <= v and (v < 256 and b == v or v - b < v / 128 + 1)


def simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(make_docs, work, rows):
    from wordtally.llm import simhash as S

    out = S.near_duplicates(make_docs(rows), work).collect()
    assert len(out) == len(rows)
    fps = {r.doc_id: r.fp & (1 << 64) - 1 for r in out}
    assert all(fps[d] == simhash(t) for d, t, *_ in rows)
    link = {d: {e for e in fps if (fps[d] ^ fps[e]).bit_count() <= 4} for d in fps}
    for r in out:
        seen, todo = set(), [r.doc_id]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += link[x]
        assert r.component_id == min((x for x in seen if x is not None), default=None)
    kept = S.keep_one(make_docs(rows), work).collect()
    assert len(kept) == len({r.root for r in out}) and list(kept[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars", "words", "fp"]


def test_simhash_links_every_close_pair(spark, work):
    from wordtally.llm import simhash as S

    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(300)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(4)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = [(a.a & (1 << 64) - 1, a.b & (1 << 64) - 1) for a in S.links(spark.createDataFrame(signed, "fp long"), work).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    group = {x: x for x in fps}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        group[root(a)] = root(b)
    fl = sorted(fps)
    for i, a in enumerate(fl):
        for b in fl[i + 1 :]:
            assert (a ^ b).bit_count() > 4 or root(a) == root(b)


def brute_cuts(rows):
    seen, out = {}, {}
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = (t or "").encode().split()
        key = (1 << 63) - 1 if d is None else d
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            first = seen.setdefault(tuple(w[s : s + 20]), (key, s))
            if first < (key, s):
                gone[s : s + 20] = [True] * 20
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [None, 3])
def test_substring_dedup(make_docs, work, rows, hot, monkeypatch):
    from wordtally.llm import substring_dedup as D
    from wordtally.llm.common import Work

    if hot:
        monkeypatch.setattr(D, "HOT_ROWS", hot)
    out = D.deduplicate(make_docs(rows), Work(work.spark)).collect()
    assert len(out) == len(rows)
    want = brute_cuts(rows)
    for r in out:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_substring_dedup_rows_that_share_an_id(make_docs, work, broadcast, monkeypatch):
    from wordtally.llm import substring_dedup as D
    from wordtally.llm.common import Work

    monkeypatch.setattr(D, "REPEATED_IDS", broadcast, raising=False)
    words = {k: " ".join(passage(900 + k, n)) for k, n in enumerate((30, 10, 50, 90, 40, 80, 5, 40, 70))}
    texts = [(3, f"{words[1]} {words[0]}"), (None, f"{words[0]} {words[2]}"), (None, words[3]), (None, f"{words[4]} {words[0]}"),
             (None, words[3]), (7, words[5]), (7, f"{words[6]} {words[0]} {words[7]}"), (8, words[8])]
    places = {}
    for d, t in texts:
        w = t.split()
        for s in range(len(w) - 19):
            places.setdefault(tuple(w[s : s + 20]), []).append((D._NO_ID if d is None else d, s))
    want = []
    for d, t in texts:
        w, key = t.split(), D._NO_ID if d is None else d
        gone = {k for s in range(len(w) - 19) if min(places[tuple(w[s : s + 20])]) < (key, s) for k in range(s, s + 20)}
        want.append((str(d), len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    out = D.deduplicate(make_docs([(d, t, "en", "web") for d, t in texts]), Work(work.spark)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in out) == sorted(want)
    assert sorted(n for _, _, n, _ in want) == [0, 0, 0, 0, 0, 30, 30, 30]


def test_fm_index_matching_statistics():
    from wordtally.llm.fm_index import FMIndex

    r = np.random.default_rng(0)
    for _ in range(20):
        segs = [r.integers(1, 4, n) for n in r.integers(1, 40, 5)]
        flat = np.concatenate([np.append(s, 0) for s in segs]).astype(np.int64)
        length = np.array([len(s) for s in segs])
        start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        ms, _ = FMIndex(flat, 20).matching_statistics(start, length, 2)
        count = {}
        for s in segs:
            for i in range(len(s)):
                for d in range(1, min(20, len(s) - i) + 1):
                    count[tuple(s[i : i + d])] = count.get(tuple(s[i : i + d]), 0) + 1
        for s, a in zip(segs, start):
            for i in range(len(s)):
                assert ms[a + i] == max((d for d in range(1, min(20, len(s) - i) + 1) if count[tuple(s[i : i + d])] > 1), default=0)


def test_byte_bpe(make_docs, rows):
    import public_tokenizers as P
    import tiktoken

    from wordtally.llm import byte_bpe as B

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {d: t or "" for d, t, *_ in rows}
    for r in B.encode_documents(make_docs(rows), path, P.PATTERN).collect():
        ids = np.array(enc.encode_ordinary(text[r.doc_id]), dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    c, rnd = B.codec(path, P.PATTERN), random.Random(1)
    for _ in range(3000):
        t = "".join(rnd.choice("aAbeéßñ  \n\t'sdlr19٣中文🙂  \x1c\x85#$%|ﬁ́") for _ in range(rnd.randint(0, 40)))
        assert list(np.frombuffer(c.encode(t), "<u4")) == enc.encode_ordinary(t)


def test_packing(make_docs, work, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from wordtally.llm import packing as K

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, x, *_ in rows}
    out = K.pack(make_docs(rows), work, path).toPandas()
    assert out["length"].sum() == sum(len(ids[d]) for d, *_ in rows)
    for r in out.fillna({"doc_id": -1}).itertuples():
        x = ids[None if r.doc_id < 0 else int(r.doc_id)]
        assert r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 2048
    unique = out[out["doc_id"].notna() & (out["doc_id"] != 4)]
    for _, g in unique.sort_values("start").groupby("doc_id"):
        assert g["start"].tolist() == [0, *g["length"].cumsum()[:-1]]


def test_packing_plan_covers_any_histogram():
    from wordtally.llm import packing as K

    r = np.random.default_rng(3)
    for kind in range(4):
        hist = np.zeros(2049, dtype=np.int64)
        if kind == 0:
            hist[1500] = 1000
        elif kind == 1:
            np.add.at(hist, r.integers(1, 2049, 5000), 1)
        elif kind == 2:
            hist[[700, 30, 2048]] = 900, 40, 3
        rows = K.plan(hist)
        used, size = {}, {}
        for cls, lo, hi, begin, length, shift, offset in rows:
            for rank in range(lo, hi):
                used.setdefault((cls, rank), []).append((begin, length))
                size.setdefault(rank + shift, []).append((offset, length))
        assert len(used) == hist.sum()
        for (cls, _), parts in used.items():
            at = 0
            for begin, length in sorted(parts):
                assert begin == at
                at += length
            assert at == cls
        for parts in size.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        if kind == 0:
            assert len(size) * 2048 - 1500 * 1000 < 0.1 * 1500 * 1000


SHA = re.compile(r"[0-9a-f]{40}")


def test_secret_scan_and_mask(make_docs, work, rows):
    from wordtally.llm import secrets as S

    more = [(100 + i, f"some words and token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" then aninternationalisation of words 4929348385146306", "en", "a") for i in range(60)]
    docs = make_docs(rows + more)
    out = S.scan(docs, work).collect()
    by = {(r.doc_id, r.value): r.is_secret for r in out}
    held = [d for d, *_ in more if zlib.crc32(str(d).encode()) % 5 == 0]
    assert held
    for d, t, *_ in more:
        assert by[d, SHA.search(t)[0]] and not by[d, "4929348385146306"] and not by[d, "aninternationalisation"]
    masked = {r.doc_id: r for r in S.mask(docs, work).collect()}
    assert masked[100].text.count("[SECRET]") == 1 and not SHA.search(masked[100].text) and masked[100].n_chars == len(masked[100].text)
    assert masked[1].text is None and masked[10].text == dict((d, t) for d, t, *_ in rows)[10]
    plan = S.scan(docs, work)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_secret_forms(make_docs, work):
    from wordtally.llm import secrets as S

    def hexes(i, n=40):
        return hashlib.sha256(f"s{i}".encode()).hexdigest()[:n]

    def b64(i, n):
        return base64.b64encode(hashlib.sha512(f"k{i}".encode()).digest()).decode()[:n]

    forms = {
        "run": lambda i: (f"set API_KEY=sk_live_{hexes(i, 24)} now", [f"sk_live_{hexes(i, 24)}"]),
        "quoted": lambda i: (f'call with api_key="{hexes(i, 32)}" here', [hexes(i, 32)]),
        "short": lambda i: (f"use password=pw-{hexes(i, 6)} or db_password: Zq{hexes(i, 5)}! there", [f"pw-{hexes(i, 6)}", f"Zq{hexes(i, 5)}"]),
        "aws": lambda i: (f"the id AKIA{hexes(i, 16).upper()} stands alone", [f"AKIA{hexes(i, 16).upper()}"]),
        "github": lambda i: (f"clone ghp_{hexes(i, 36)} alone", [f"ghp_{hexes(i, 36)}"]),
        "pem": lambda i: (f"-----BEGIN RSA PRIVATE KEY-----\n{b64(i, 64)}\n{b64(-i - 1, 10)}\n-----END RSA PRIVATE KEY----- end", [b64(i, 64), b64(-i - 1, 10)]),
    }
    rows, want = [], {}
    for k, (name, form) in enumerate(forms.items()):
        for i in range(15):
            text, found = form(100 * k + i)
            rows.append((1000 + 100 * k + i, f"word aninternationalisation and 4929348385146306 {text} the secret: we went", "en", "a"))
            want[rows[-1][0]] = name, found
    docs = make_docs(rows)
    judged = {(r.doc_id, r.value): r.is_secret for r in S.scan(docs, work).collect()}
    masked = {r.doc_id: r.text for r in S.mask(docs, work).collect()}
    for d, (name, found) in want.items():
        for v in found:
            assert judged.get((d, v)), (name, v)
            assert v not in masked[d], (name, masked[d])
        assert not judged[d, "aninternationalisation"] and not judged[d, "4929348385146306"]
        assert masked[d].endswith("the secret: we went") and not judged[d, "we"]
    # one form, and no rows of the rule in the training fold at all
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held
    alone = {(r.doc_id, r.value): r.is_secret for r in S.scan(make_docs(held), work).collect()}
    assert all(alone[r[0], v] for r in held for v in want[r[0]][1]) and not any(alone[r[0], "aninternationalisation"] for r in held)


def test_empty_tables(spark, make_docs, work):
    import public_tokenizers as P

    from wordtally.llm import byte_bpe, packing, quality_pu, quality_rules, secrets, simhash, substring_dedup, toxicity

    none = make_docs([])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        quality_rules.judge(none, work), simhash.near_duplicates(none, work), substring_dedup.deduplicate(none, work), secrets.scan(none, work),
        packing.pack(none, work, P.path("word_bpe_49k.json")), byte_bpe.encode_documents(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
        quality_pu.score(none, labels, work), toxicity.score(none, *toxicity.train(none, labels)),
    ):
        assert out.count() == 0


def test_byte_bpe_time_is_linear_in_a_piece():
    """One match of the split pattern with tokens that never fit greedily: four times the text takes about four times as long."""
    import time

    import public_tokenizers

    from wordtally.llm.byte_bpe import Codec

    c = Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    c.encode("ab" * 1000)

    def seconds(n):
        start = time.process_time()
        ids = c.encode("ab" * n)
        took = time.process_time() - start
        assert c.decode(ids) == b"ab" * n
        return took

    small, large = seconds(125_000), seconds(1_000_000)
    assert large < 24 * small  # a quadratic encoder takes 64 times as long


def test_forest_decides_beyond_the_rule(make_docs, work):
    """A form that no label shows is found; a value that the rule takes for a secret is rejected where findings say so."""
    from pyspark.sql import functions as F

    from wordtally.llm import secrets as S

    def hexes(i, n):
        return hashlib.sha256(f"z{i}".encode()).hexdigest()[:n]

    def long_word(i):
        return "".join(("inter", "nation", "under", "standing", "re", "present", "ation", "able")[(i // 8**k) % 8] for k in range(3)) + "alisations"

    rows = []
    for i in range(240):
        rows += [
            (10 * i, f"we set api_key = {hexes(i, 40)} for it and {long_word(i)} of {4929348385146306 + 7919 * i} here", "en", "a"),
            (10 * i + 1, f"clone with ghp_{hexes(-i - 1, 36)} from there", "en", "a"),
            (10 * i + 3, f"the id AKIA{hexes(i + 5000, 16).upper()} stands, and so does glpat-{hexes(i + 6000, 24)} in it", "en", "a"),
            (10 * i + 4, f"charged by sk_live_{hexes(i + 7000, 28)} once", "en", "a"),
            (10 * i + 2, f"the next page_token: 2024-{i % 12 + 1:02}-{i % 28 + 1:02}-{i:03} of the list", "en", "a"),
        ]
    docs = make_docs(rows)
    counted = work.store(S.vocabulary(docs), "counted")
    found = work.store(S.candidates(docs), "cands")
    labels = S.labelled_by_rule(found, S.dictionary(counted)).where("NOT value LIKE 'ghp%'")
    paged = F.col("left1").startswith("page_token")
    assert labels.where(paged & (F.col("label") == 1)).count() > 0  # what the rule says
    labels = labels.withColumn("label", F.when(paged, 0).otherwise(F.col("label")))
    judged = S.judge(found, labels, counted, work).collect()
    held = [r for r in judged if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    unseen = [r.is_secret for r in held if r.value.startswith("ghp_")]
    assert len(unseen) > 20 and sum(unseen) >= 0.9 * len(unseen)
    pages = [r.is_secret for r in held if r.value.startswith("2024-")]
    assert len(pages) > 20 and not any(pages)
    assert all(r.is_secret for r in held if r.doc_id % 10 == 0 and re.fullmatch("[0-9a-f]{40}", r.value))
    harmless = [r.is_secret for r in held if re.fullmatch("[a-z]+|[0-9]+", r.value)]
    assert len(harmless) > 50 and not any(harmless)
