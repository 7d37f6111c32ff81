"""Plans and files that have to keep their shape: what is shuffled, which buckets are rewritten."""

import os

import pytest
from pyspark.sql import functions as F

from wordtally.functions import lemma as L
from wordtally.operators import learners as LR
from wordtally.operators import registry as R
from wordtally.operators.ranking import dense_index
from wordtally.plans import REGISTRY, load_all
from wordtally.sources import sinks
from wordtally.sources.tables import announcements, may_have_label

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["content_dedup", "select_docs", "import_upsert", "scan_docs"])
def test_no_text_is_shuffled_to_the_labels(spark, name):
    load_all()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cols = {"content_dedup": ["orig_md5"], "scan_docs": ["id", "class_label", "orig_md5"], "import_upsert": ["id", "class_label", "orig_md5"]}.get(name)
        df = announcements(spark, SF).select(*cols) if cols else REGISTRY[name](spark, SF)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    top = plan.split("Join ")[0]  # above the join with the labels
    assert "text#" not in top and "words#" not in top


def registry_rows(spark, ids, label):
    rows = [(i, i, f"hash{i}", "s", None, label, 1.0, 1.0, f"u{i}", f"p{i}", "txt", True) for i in ids]
    return spark.createDataFrame(
        rows,
        "id long, seq long, orig_md5 string, symbol string, associated_date date, class_label string, error_cost double, "
        "success_gain double, original_url string, path_saved string, file_type string, use_saved boolean",
    )


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("modify", [False, True])
def test_only_touched_buckets_are_rewritten(spark, tmpdir_path, modify):
    path = os.path.join(tmpdir_path, "registry")
    first, second = registry_rows(spark, range(200), "pos"), registry_rows(spark, [3, 500], "neg")
    R.import_batch(spark, path, first, modify, buckets=16)
    before = files_of(path)
    got = R.import_batch(spark, path, second, modify, buckets=16)
    touched = {r.bucket for r in got.where("id IN (3, 500)").select("bucket").collect()}
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept and all(files_of(path).get(f) == before[f] for f in kept)
    whole = R.upsert(R.upsert(None, first, modify), second, modify)
    assert sorted(map(str, got.drop("bucket").collect())) == sorted(map(str, whole.select(*got.drop("bucket").columns).collect()))
    again = R.import_batch(spark, path, second, modify, buckets=16)  # a batch imported twice
    assert again.count() == 201 and again.where("id = 3").first().class_label == ("neg" if modify else "pos")


def test_lemmas_do_not_shuffle_tokens(spark):
    docs = spark.createDataFrame([(1, ["films", "good", "films"], "x"), (2, None, "y"), (3, [], "z"), (4, ["walked", None], "w")], "id long, words array<string>, other string")
    table = spark.createDataFrame([("films", "film"), ("walked", "walk")], "form string, lemma string")
    out = L.apply_lemmas(docs, table)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: (r.words, r.other) for r in out.collect()}
    assert got == {1: (["film", "good", "film"], "x"), 2: ([], "y"), 3: ([], "z"), 4: (["walk", None], "w")}
    spark.conf.set("wordtally.broadcast.maxRows", "1")
    try:
        big = {r.id: r.words for r in L.apply_lemmas(docs.where("id < 4"), table).collect()}
    finally:
        spark.conf.unset("wordtally.broadcast.maxRows")
    assert big == {1: ["film", "good", "film"], 2: [], 3: []}


def test_ranks_within_a_null_group(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "g string, x int")
    assert {(r.g, r.x): r.idx for r in dense_index(df, [F.col("x")], group="g").collect()} == {(None, 1): 0, (None, 3): 1, ("a", 2): 0}


def test_samples_keep_every_document(spark, tmpdir_path):
    feats = spark.createDataFrame([(1, 0, 2.0)], "id long, idx int, value double")
    ids, marked = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2,)], "id long")
    sinks.write_samples(feats, marked, os.path.join(tmpdir_path, "s"), ids, size=4, transformation="t")
    values, docs = sinks.read_samples(spark, os.path.join(tmpdir_path, "s"))
    assert [tuple(r) for r in values.collect()] == [(1, 0, 2.0)]
    assert sorted(map(tuple, docs.collect())) == [(1, False, 4, "t"), (2, True, 4, "t")]


def test_neighbour_search_shuffles_no_block_twice(spark):
    docs = [(i, 1 if i % 3 else -1, i % 4, [i % 5, 5 + i % 7], [1.0, 0.5 * (i % 2)]) for i in range(120)]
    rows = spark.createDataFrame([("m", *d) for d in docs] + [("n", *docs[0]), ("m", *docs[1])], "space string, id long, y int, fold int, ix array<int>, vx array<double>")
    found = LR.knn_search(rows, rows, k=3, block_rows=8, query_block_rows=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan  # no copy of a block for each block of the other side
    got = {}
    for r in found.collect():
        got.setdefault((r.space, r.qid), []).append((r.d2, r.tid))
    assert ("n", 0) not in got  # alone in its space

    def d2(a, b):
        x, y = dict(zip(docs[a][3], docs[a][4])), dict(zip(docs[b][3], docs[b][4]))
        return round(sum((x.get(c, 0) - y.get(c, 0)) ** 2 for c in {*x, *y}), 6)

    for q in range(120):
        near = sorted((d2(q, t), t) for t in [*range(120), 1] if t % 4 != q % 4)  # row 1 comes twice
        near = sorted(near * 2)[:3] if q == 1 else near[:3]
        assert sorted(got["m", q]) == near


def test_texts_of_the_other_side_are_left_out_before_they_are_tokenized(spark, tmpdir_path):
    docs = [(i, "s", 10, f"One text {i}.", "en") for i in (1, 2, 3, 4, 5, 6, 6)] + [(None, "s", 10, "No id.", "en")]
    labels = [(1, 1, 0), (2, 0, 1), (3, None, 0), (4, 1, 0), (4, None, 0), (6, 1, 0), (6, 0, 0), (None, 1, 0)]
    spark.createDataFrame(docs, "doc_id long, source string, n_chars long, text string, lang string").write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmpdir_path}/labels.parquet")
    read, known = spark.read.parquet(f"{tmpdir_path}/documents.parquet"), spark.read.parquet(f"{tmpdir_path}/labels.parquet")
    assert sorted(r.doc_id for r in may_have_label(read, known, True).collect()) == [1, 2, 4, 6, 6]
    assert sorted(r.doc_id or 0 for r in may_have_label(read, known, False).collect()) == [0, 3, 4, 5]
    for labelled, mine in ((True, "class_label <> 'none'"), (False, "class_label = 'none'")):
        whole, part = announcements(spark, tmpdir_path).where(mine), announcements(spark, tmpdir_path, labelled).where(mine)
        assert sorted(map(str, whole.collect())) == sorted(map(str, part.collect())) and whole.count() > 0
    spark.conf.set("wordtally.broadcast.maxRows", "1")
    try:
        assert may_have_label(read, known, True).count() == len(docs)
    finally:
        spark.conf.unset("wordtally.broadcast.maxRows")


def test_lemmas_hold_few_documents_at_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(L, "LEMMA_ROWS", 3)
    words = [["films", "good"], None, [], ["walked", None], ["films"], ["x", "walked", "films"], ["good"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(words, pa.list_(pa.string()))], names=["id", "words"])
    out = list(L._replaced([batch], pa.array(["films", "walked"]), pa.array(["film", "walk"]), ["id", "words"]))
    assert [b.num_rows for b in out] == [3, 3, 1]
    got = [w for b in out for w in b["words"].to_pylist()]
    assert got == [["film", "good"], [], [], ["walk", None], ["film"], ["x", "walk", "film"], ["good"]]
    assert [i for b in out for i in b["id"].to_pylist()] == list(range(7))


def test_blocks_of_the_search_are_dealt_evenly(spark, monkeypatch):
    import pyarrow as pa

    def counting(k):
        def run(batches):
            n = sum(b.num_rows for b in batches)
            columns = [["x"], [n], [0], [0], [0], [0], [0.0]]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["space", "qid", "qfold", "qy", "tid", "ty", "d2"])

        return run

    monkeypatch.setattr(LR, "_search_blocks", counting)
    rows = spark.range(256).selectExpr("'' space", "id", "1 y", "cast(id % 2 AS int) fold", "array(0) ix", "array(1D) vx")
    found = LR.knn_search(rows, rows, k=100, block_rows=256, query_block_rows=16)
    assert [r.qid for r in found.collect()] == [1] * 16  # a pair of blocks a task


def test_products_of_blocks_equal_the_dense_ones(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = np.where(rng.random((70, 50)) < rng.random(50), rng.random((70, 50)), 0.0)
    x[5] = 0.0

    def block(rows):
        where = [np.nonzero(r)[0].astype(np.int32) for r in rows]
        n = len(rows)
        table = pa.table({"space": [""] * n, "block": pa.array([0] * n, pa.int32()), "id": list(range(n)), "y": pa.array([1] * n, pa.int32()), "fold": pa.array([0] * n, pa.int32()),
                          "ix": pa.array(where, pa.list_(pa.int32())), "vx": pa.array([r[w] for r, w in zip(rows, where)], pa.list_(pa.float64()))})
        packed = LR._pack_block(table)
        return LR._Block(packed.rename_columns([f"q_{c}" for c in packed.column_names]).combine_chunks().to_batches()[0], 0, "q")

    for strip, pairs, heavy in ((7, 9, 0.4), (64, 1 << 17, 2.0), (64, 1 << 17, 0.0)):
        monkeypatch.setattr(LR, "STRIP_ROWS", strip)
        monkeypatch.setattr(LR, "STRIP_PAIRS", pairs)
        monkeypatch.setattr(LR, "HEAVY_SHARE", heavy)
        parts = list(LR._Columns(block(x[:40])).dots(block(x[40:])))
        assert [top for top, _ in parts] == list(range(0, 30, strip))
        assert np.allclose(np.concatenate([p for _, p in parts]), x[40:] @ x[:40].T, atol=1e-12)
