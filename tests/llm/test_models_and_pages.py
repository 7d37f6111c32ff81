"""Held-out accuracy of the classifiers, recall of the graph index, wrappers of pages, and the pipeline."""

import html
import re
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.01"


def held_out_accuracy(spark, out, label):
    j = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where(f"held_out AND {label} IS NOT NULL")
    r = [(x["predicted"], x[label]) for x in j.collect()]
    return np.mean([a == b for a, b in r])


def test_classifiers(spark, make_docs, work):
    from wordtally.llm import quality_pu, toxicity

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    q = quality_pu.score(docs, labels, work)
    assert held_out_accuracy(spark, q, "quality") > 0.9
    t = toxicity.score(docs, *toxicity.train(docs, labels))
    assert held_out_accuracy(spark, t, "toxic") > 0.85
    edge = make_docs([(1, None, "en", "a"), (2, "", None, None), (2, "", None, None), (None, "x " * 50_000, "en", "a")])
    for out in (quality_pu.score(edge, labels, work).collect(), toxicity.score(edge, *toxicity.train(edge, labels)).collect()):
        assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in q.collect())


@pytest.mark.parametrize("cap", [4_000, 40])
def test_toxicity_keeps_the_balance_of_the_labelled_rows(spark, make_docs, cap, monkeypatch):
    from wordtally.llm import toxicity

    monkeypatch.setattr(toxicity, "MAX_ROWS", cap)
    # a word found in 80 % of 60 toxic rows and 15 % of 600 clean ones: toxic with a probability of about 48 / 138
    rows = [(i, i < 60, (i % 5 != 0) if i < 60 else (i % 20 < 3)) for i in range(660)]
    docs = make_docs([(3 * i, f"some plain words {'zyxwvut' if bad else 'common'} here", "en", "a") for i, _, bad in rows])
    labels = spark.createDataFrame([(3 * i, int(toxic)) for i, toxic, _ in rows], "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score(docs, *toxicity.train(docs, labels)).collect()}
    scores = np.array([out[3 * i] for i, _, bad in rows if bad])
    assert 0.15 < scores.mean() < 0.5, scores.mean()
    assert abs(np.mean(list(out.values())) - 60 / 660) < 0.04, np.mean(list(out.values()))


def test_toxicity_by_class_and_by_brute_force(spark, work):
    """Held-out recall and precision at sf0.1; counts and scores recomputed row by row."""
    from wordtally.llm import toxicity as T

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("toxic IN (0, 1) AND crc32(cast(cast(doc_id AS string) AS binary)) % 5 != 0").selectExpr("doc_id", "cast(toxic AS int) AS y").distinct()
    counts = T.feature_counts(docs, known).toPandas().set_index("f")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    y = {r.doc_id: r.y for r in known.collect()}
    n = np.zeros((2, 1 << T.BITS), dtype=int)
    for d in y:
        if d in text:
            n[y[d], T.features(text[d])] += 1
    at = counts.index[counts.index < 1 << T.BITS]
    assert set(at) == set(np.nonzero(n.any(axis=0))[0]) and (counts.loc[at, "p"] == n[1, at]).all() and (counts.loc[at, "q"] == n[0, at]).all()
    ids, w, b = T.train(docs, labels, work=work)
    out = {r.doc_id: r for r in T.score(docs, ids, w, b).collect()}
    weight = dict(zip(ids.tolist(), w))
    for d in list(text)[:200]:
        z = b + sum(weight.get(f, 0.0) for f in T.features(text[d]).tolist())
        assert abs(out[d].score - 1 / (1 + np.exp(-z))) < 1e-9
    truth = {r.doc_id: r.toxic for r in labels.where("toxic IN (0, 1)").collect()}
    hits = [(out[d].predicted, t) for d, t in truth.items() if d in out and out[d].held_out]
    both = sum(p and t for p, t in hits)
    assert both >= 0.84 * sum(t for _, t in hits) and both >= 0.95 * sum(p for p, _ in hits), (both, len(hits))


def test_repeated_and_contradicting_labels(spark, make_docs):
    from wordtally.llm import toxicity as T

    docs = make_docs([(3 * i, f"some plain words {'zyxwvut' if i < 40 else 'common'} here", "en", "a") for i in range(200)])
    rows = [(3 * i, int(i < 40)) for i in range(200)]
    once = T.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    again = T.train(docs, spark.createDataFrame(rows + rows[:30] * 5, "doc_id long, toxic int"))
    assert (once[0] == again[0]).all() and np.allclose(once[1], again[1]) and abs(once[2] - again[2]) < 1e-9
    none = T.train(docs, spark.createDataFrame([(d, 1 - y) for d, y in rows] + rows, "doc_id long, toxic int"))
    assert not len(none[0]) and all(r.score < 1e-9 for r in T.score(docs, *none).collect())


def test_graph_index(spark, work):
    from wordtally.llm import vamana

    r = np.random.default_rng(1)
    centre = r.normal(size=(20, 16))
    v = [(i, (centre[i % 20] + 0.6 * r.normal(size=16)).astype(np.float32).tolist()) for i in range(2000)]
    v += [(3000 + i, [1.0] * 16) for i in range(300)]  # one very common vector
    odd = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, []), (5200, [None] * 16), (5250, [1.0, 2.0])]
    out = vamana.nearest(spark.createDataFrame(v + odd, "vec_id long, embedding array<float>"), work).toPandas()
    ids = np.array([i for i, _ in v])
    x = np.array([e for _, e in v], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    queries = ids[ids % 50 == 0]
    assert set(out["query_id"]) == set(queries)
    for q in queries:
        s = x @ x[ids == q][0]
        s = np.where(ids == q, -9, np.round(s, 12))
        g = out[out["query_id"] == q].sort_values("rank")
        assert g["rank"].tolist() == [1, 2, 3, 4, 5]
        hit += len(set(g["vec_id"]) & set(ids[np.lexsort((ids, -s))[:5]]))
    assert hit / (5 * len(queries)) >= 0.9
    assert out[out["query_id"] == 3000].sort_values("rank")["vec_id"].tolist() == [3001, 3002, 3003, 3004, 3005]
    assert vamana.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), work).count() == 0


def test_wrappers(spark, work):
    from wordtally.llm import html_wrapper as H

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in H.extract(pages, work).collect():
        inner = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    plain = "<body><div class='menu'>Menu</div><div><p>One <b>two</b> <i>three</i></p><p>Four &amp; five</p></div><div id='comments'><p>Nice</p></div><form>Name</form></body>"
    rows = [(1, None, None, 3), (2, "http://a.b/x", "", 3), (3, "http://a.b/y", plain, 3), (4, "http://a.b/z", plain, 3), (4, "http://a.b/z", plain, 3), (5, "::", "<p>" * 3000 + "deep", 3)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), work).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 6 and text[1] == text[2] == "" and text[3] == text[4] == "One two three\nFour & five" and text[5] == "deep"
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string"), work).count() == 0


def test_wrappers_compare_texts(spark, work):
    from wordtally.llm import html_wrapper as H

    def page(i, notice, where="div"):
        return f"<body><div class='x'><p>Story {i} begins on a day like no other {i * 7}.</p><{where}>{notice}</{where}><h2>Sources</h2><p>It ends with line {i} and {i + 3}.</p></div></body>"

    notice = "By reading this page you accept all of our terms, <b>and more</b>."
    rows = [(i, f"http://terms.example/{i}", page(i, notice)) for i in range(20)]
    # a marked article: long constant texts are template, short labels and headings are not
    rows += [(100 + i, f"http://marked.example/{i}", f"<article><h1>All about everything we ever wrote</h1><p>Summary</p><p>{notice}</p><p>Text {i} of many, and long enough to be most of what is on page {i}.</p></article>") for i in range(20)]
    # one article under twenty addresses, each with another short line: nothing of it is template
    rows += [(200 + i, f"http://copies.example/{i}", f"<div><p>{'one long article that is copied ' * 9}</p><p>another paragraph of the same article</p><p>Visit {i}</p></div>") for i in range(20)]
    # a sentence that a few of many articles share stays
    rows += [(300 + i, f"http://shared.example/{i}", page(i, "Each of us knows this old saying by heart." if i < 6 else f"Line {i}.", "p")) for i in range(20)]
    # too few articles to tell
    rows += [(400 + i, f"http://few.example/{i}", page(i, notice)) for i in range(3)]
    text = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), work).collect()}
    story = "Story {0} begins on a day like no other {1}.\n{2}Sources\nIt ends with line {0} and {3}."
    plain = "By reading this page you accept all of our terms, and more.\n"
    for i in range(20):
        assert text[i] == story.format(i, i * 7, "", i + 3)
        assert text[100 + i] == f"All about everything we ever wrote\nSummary\nText {i} of many, and long enough to be most of what is on page {i}."
        assert text[200 + i] == f"{('one long article that is copied ' * 9).strip()}\nanother paragraph of the same article\nVisit {i}"
        assert text[300 + i] == story.format(i, i * 7, "Each of us knows this old saying by heart.\n" if i < 6 else f"Line {i}.\n", i + 3)
    for i in range(3):
        assert text[400 + i] == story.format(i, i * 7, plain, i + 3)


@pytest.mark.parametrize(
    "page",
    [
        '<div class="content has-sidebar"><article><p>A b</p></article></div>',
        '<div class="search-result"><main><p>A b</p></main></div><p>More</p>',
        "<!-- <article> --><p>A b</p>",
        '<p>A b</p><section id="comments"><article class="comment"><p>Nice</p></article></section>',
        '<form><article class="post has-comments"><p>A b</p><article class="comment"><p>Nice</p></article></article></form>',
        "<aside><article><p>Teaser</p></article></aside><p>A b</p>",
        "<p>A b</p><article></article>",
    ],
)
def test_articles_beat_the_names_around_them(page):
    from wordtally.llm import html_wrapper as H

    assert H.main_text(page, "[null, {}]") == "A b"


def test_alignment_is_longest_and_linear_in_memory(monkeypatch):
    import time

    from wordtally.llm import html_wrapper as H

    r = np.random.default_rng(3)
    monkeypatch.setattr(H, "TABLE_CELLS", 16)
    for _ in range(200):
        a, b = ([str(k) for k in r.integers(0, 5, r.integers(0, 70))] for _ in range(2))
        pairs = H.align(a, b)
        assert len(pairs) == len(H._table(a, b)) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    monkeypatch.undo()
    start = time.time()
    assert len(H.align([f"t{i}" for i in range(40_000)], [f"t{i}" for i in range(20_000, 60_000)])) == 20_000
    pages = ["".join(f"<t{chr(97 + i % 26)}{'x' * (i % 37)}q{'y' * (i % 41)}>w</p>" for i in range(k, k + 20_000)) for k in (0, 7)]
    w = H.Wrapper()
    for p in pages:
        w.add_stream([(t[0], t[2]) for t in H.tokens(p)], 1)
    assert time.time() - start < 60


def test_wrapper_folds_repeats_and_optionals():
    from wordtally.llm.html_wrapper import Wrapper

    w = Wrapper()
    w.add_stream([("<ul>", False), *[("<li>", False), ("#", True), ("</li>", False)] * 3, ("</ul>", False)], 2)
    w.add_stream([("<ul>", False), ("<li>", False), ("#", True), ("</li>", False), ("</ul>", False), ("<p>", False), ("#", False), ("</p>", False)], 1)
    assert [(u[0], u[2]) for u in w.units] == [("<ul>", False), ("(<li> # </li>)+", False), ("</ul>", False), ("<p>", True), ("#", True), ("</p>", True)]


def test_pipeline(spark):
    import corpus_pipeline as C
    from wordtally.llm import quality_rules, simhash, substring_dedup
    from wordtally.llm.common import Work

    docs, work, kept = spark.read.parquet(f"{SF}/documents.parquet"), Work(spark), None
    for k, (name, stage) in enumerate(C.STAGES[:-1]):
        before = {r.doc_id: r for r in docs.collect()}
        docs = work.store(stage(spark, docs, SF), f"t{k}")
        assert docs.columns == C.COLUMNS
        kept = {r.doc_id: r for r in docs.collect()}
        if k == 0:
            m = {d: quality_rules.measure(r.text) for d, r in before.items()}
            assert all(m[d][0] >= 50 and 100 * m[d][4] <= 50 * m[d][0] for d in kept)
            quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            clean = [d for d, x in m.items() if quality.get(d) == 1 and x[0] >= 50 and 100 * x[4] <= 50 * x[0]]
            assert np.mean([d in kept for d in clean]) > 0.98
        if k == 1:
            fp = {d: simhash.fingerprint(r.text) for d, r in before.items()}
            left = sorted(kept)
            assert all((fp[a] ^ fp[b]).bit_count() > 4 for i, a in enumerate(left) for b in left[i + 1 :])
            assert all(any((fp[d] ^ fp[e]).bit_count() <= 4 for e in before if e != d) for d in before if d not in kept)
        if k == 2:
            seen = {}
            for d in sorted(before):
                w = (before[d].text or "").encode().split()
                gone = [False] * len(w)
                for s in range(len(w) - substring_dedup.WINDOW + 1):
                    if seen.setdefault(tuple(w[s : s + 20]), (d, s)) < (d, s):
                        gone[s : s + 20] = [True] * 20
                want = before[d].text if not any(gone) else b" ".join(x for x, g in zip(w, gone) if not g).decode()
                assert (d in kept) == (not gone or not all(gone)) and (d not in kept or kept[d].text == want)
        if k == 3:
            assert kept.keys() == before.keys() and not any(re.search(r'token = "[0-9a-f]{40}', r.text or "") for r in kept.values())
    pieces = C.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(pieces["doc_id"]) == set(kept)
    assert (pieces.groupby("sequence_id")["length"].sum() <= 2048).all()
    assert pieces.groupby("doc_id")["length"].sum().eq(pieces.groupby("doc_id")["doc_tokens"].first()).all()


def test_query_blocks_are_not_broadcast(spark, work, monkeypatch):
    from wordtally.llm import vamana

    monkeypatch.setattr(vamana, "SHARD_ROWS", 64)
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(500)]
    out = vamana.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), work)
    assert out.count() == 50
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_only_labelled_texts_are_joined(spark, work):
    from wordtally.llm import toxicity

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)] + [(7, "again"), (None, "x")], "doc_id long, text string")
    known = spark.createDataFrame([(i,) for i in range(0, 2000, 7)], "doc_id long")
    kept = toxicity.with_key_in(docs, known)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(7) == 2 and set(range(0, 2000, 7)) <= set(ids)
    assert len(ids) < 500  # the rest never reaches the join
    assert toxicity.with_key_in(docs, known.limit(0)).count() == 0
