"""Manifests, cell typing, upserts, labels and merges (FIXTURES.md)."""

import datetime as dt
import os

from pyspark.sql import Row
from pyspark.sql import functions as F

from wordtally.functions import cells as C
from wordtally.operators import registry as R
from wordtally.sources import manifest as M


def test_cell_typing(spark):
    df = spark.createDataFrame([(c,) for c in ["31.12.2011", "1e3", "nan", " x ", "5d", "1.2.2011", " 7 "]], "c string")
    got = {r.c: r for r in df.select("c", C.cell_kind(F.col("c")).alias("k"), C.cell_date(F.col("c")).alias("d"),
                                    C.cell_number(F.col("c")).alias("n"), C.cell_text(F.col("c")).alias("t")).collect()}
    assert got["31.12.2011"].k == "date" and got["31.12.2011"].d == dt.date(2011, 12, 31)
    assert got["1.2.2011"].d == dt.date(2011, 2, 1)
    assert got["1e3"].k == "number" and got["1e3"].n == 1000.0
    assert got["nan"].k == "text" and got["nan"].t == "nan"
    assert got[" x "].k == "text" and got[" x "].t == "x"
    assert got["5d"].k == "text"
    assert got[" 7 "].n == 7.0


def test_file_types(spark):
    df = spark.createDataFrame([(p,) for p in ["a/B.TXT", "x.text", "p.htm", "q.html", "r.pdf", "s.doc", "noext", " t.txt "]], "p string")
    got = [r.t for r in df.select(C.file_type(F.col("p")).alias("t")).collect()]
    assert got == ["txt", "txt", "html", "html", "pdf", "unknown", "unknown", "txt"]


def test_manifest_read_unpivot_check(spark, tmpdir_path):
    good = os.path.join(tmpdir_path, "good.csv")
    bad = os.path.join(tmpdir_path, "bad.csv")
    with open(good, "w", encoding="utf-8") as f:
        f.write("Code;Date;Class Label;Error Cost;Success Gain;Announcement\n")
        f.write("AAA;31.12.2011;pos;1;2;a.txt;b.html;c.pdf\n")
        f.write("BBB;01.01.2012;neg;1;1;;d.txt\n")
        f.write("CCC;02.01.2012;neg;1;1\n")
    with open(bad, "w", encoding="utf-8") as f:
        f.write("Symbol;Date;Class Label;Error Cost;Success Gain;Announcement\nX;1.1.2012;pos;1;1;z.txt\n")
    wide, rejected = M.read_manifests(spark, [good, bad], max_paths=4)
    assert rejected == [bad]
    rows = M.unpivot(M.typed(wide)).collect()
    per_code = {}
    for r in rows:
        per_code.setdefault(r.code, []).append(r.path)
    assert per_code == {"AAA": ["a.txt", "b.html", "c.pdf"], "BBB": ["d.txt"]}
    assert M.check_counts(wide).first().announcements == 4
    aaa = [r for r in rows if r.code == "AAA"][0]
    assert aaa.date == dt.date(2011, 12, 31) and aaa.error_cost == 1.0 and aaa.success_gain == 2.0


def _inc(spark, rows):
    return spark.createDataFrame(
        [Row(id=i, seq=s, orig_md5=m, symbol="S", associated_date=dt.date(2011, 1, 1), class_label=lab, error_cost=1.0,
             success_gain=1.0, original_url=url, path_saved=url, file_type="txt", use_saved=False) for i, s, m, lab, url in rows]
    )


def test_upsert_same_md5_twice(spark):
    inc = _inc(spark, [(1, 1, "h", "pos", "one.txt"), (2, 2, "h", "neg", "two.txt")])
    mod = R.upsert(None, inc, modify=True).first()
    assert (mod.id, mod.class_label, mod.original_url, mod.path_saved) == (1, "neg", "two.txt", "one.txt")
    keep = R.upsert(None, inc, modify=False).first()
    assert (keep.id, keep.class_label, keep.original_url, keep.path_saved) == (1, "pos", "one.txt", "one.txt")
    st = {r.seq: r.status for r in R.import_status(None, inc, modify=False).collect()}
    assert st == {1: "inserted", 2: "skipped"}


def test_upsert_is_idempotent(spark):
    inc = _inc(spark, [(1, 1, "h", "pos", "one.txt"), (2, 2, "g", "neg", "two.txt")])
    reg = R.upsert(None, inc, modify=False)
    again = R.upsert(reg, inc, modify=False)
    assert sorted(map(tuple, reg.collect())) == sorted(map(tuple, again.collect()))
    st = {r.seq: r.status for r in R.import_status(reg, inc).collect()}
    assert st == {1: "skipped", 2: "skipped"}


def test_missing_file_status(spark):
    manifest = spark.createDataFrame([Row(id=1, seq=1, original_url="there.txt"), Row(id=2, seq=2, original_url="gone.txt")])
    files = spark.createDataFrame([Row(path="there.txt", orig_md5="abc")])
    inc = R.incoming_rows(manifest, files)
    st = {r.original_url: r.status for r in R.import_status(None, inc).collect()}
    assert st == {"there.txt": "inserted", "gone.txt": "missing"}


def test_label_update_first_match(spark):
    reg = _inc(spark, [(1, 1, "h1", "pos", "a.txt"), (2, 2, "h2", "pos", "b.txt")]).withColumn("xpath", F.lit(None).cast("string"))
    labels = spark.createDataFrame(
        [Row(path="a.txt", class_label="neg", error_cost=3.0, success_gain=5.0, seq=1),
         Row(path="a.txt", class_label="pos", error_cost=4.0, success_gain=6.0, seq=2),
         Row(path="zzz.txt", class_label="neg", error_cost=1.0, success_gain=1.0, seq=3)]
    )
    out = {r.id: r for r in R.label_update(reg, labels).collect()}
    assert (out[1].class_label, out[1].error_cost, out[1].relabelled) == ("pos", 4.0, True)
    assert (out[2].class_label, out[2].relabelled) == ("pos", False)
    st = {r.path: r.status for r in R.label_status(reg, labels).collect()}
    assert st["zzz.txt"] == "no such record"


def test_merge_same_symbol_date(spark):
    tok = spark.createDataFrame(
        [Row(id=1, seq=1, symbol="S", associated_date=dt.date(2011, 1, 1), class_label="pos", error_cost=1.0, success_gain=1.0,
             sentences=2, tokens=5),
         Row(id=2, seq=2, symbol="S", associated_date=dt.date(2011, 1, 1), class_label="neg", error_cost=2.0, success_gain=3.0,
             sentences=1, tokens=4)]
    )
    m = R.merge_tokenized(tok).first()
    assert (m.class_label, m.error_cost, m.sentences, m.tokens, m.parts) == ("neg", 2.0, 3, 9, 2)
    parts = {r.id: r.part_no for r in R.merge_parts(tok).collect()}
    assert parts == {2: 0, 1: 1}  # later sentences first


def test_selection_bounds(spark):
    tok = spark.createDataFrame(
        [Row(id=i, symbol="S", associated_date=d, class_label=lab, sentences=1)
         for i, (d, lab) in enumerate([(dt.date(2011, 1, 1), "pos"), (dt.date(2011, 1, 31), "neg"), (dt.date(2011, 1, 15), "none"),
                                       (dt.date(2011, 2, 1), "pos")])]
    )
    got = sorted(r.id for r in R.select_docs(tok, "2011-01-01", "2011-01-31").collect())
    assert got == [0, 1]


def test_demo_manifest(spark):
    files = spark.createDataFrame([(f"corpus/{c}/{i:03d}.txt",) for c in ("neg", "pos") for i in range(3)], "path string")
    rows = M.generate_demo(files, short_per_class=2).orderBy("path").collect()
    neg = [r for r in rows if r.class_label == "neg"]
    assert [r.code for r in neg] == ["MOVIE_SHORT", "MOVIE_SHORT", "MOVIE"]
    assert [r.date for r in neg] == ["03.01.1990", "05.01.1990", "07.01.1990"]
    assert [r.date for r in rows if r.class_label == "pos"][0] == "04.01.1990"


def test_import_end_to_end(spark, tmpdir_path):
    from wordtally.sources.files import scan_files

    docs = os.path.join(tmpdir_path, "docs")
    os.makedirs(docs)
    for name, text in [("a.txt", "same text"), ("b.txt", "same text"), ("c.html", "<p>other</p>")]:
        with open(os.path.join(docs, name), "w") as f:
            f.write(text)
    man = os.path.join(tmpdir_path, "m.csv")
    with open(man, "w", encoding="utf-8") as f:
        f.write("Code;Date;Class Label;Error Cost;Success Gain;Announcement\n")
        f.write("AAA;01.02.2012;pos;1;2;a.txt;c.html\n")
        f.write("BBB;02.02.2012;neg;3;1;b.txt;missing.txt\n")
    wide, rejected = M.read_manifests(spark, [man], max_paths=4)
    assert rejected == []
    rows = M.announcement_rows(wide, root=docs)
    inc = R.incoming_rows(rows, scan_files(spark, docs))
    st = {os.path.basename(r.original_url): r.status for r in R.import_status(None, inc).collect()}
    assert st == {"a.txt": "inserted", "c.html": "inserted", "b.txt": "skipped", "missing.txt": "missing"}
    reg = {os.path.basename(r.original_url): r for r in R.upsert(None, inc, modify=True).collect()}
    # b.txt has a's content: with modify the later row relabels the same registry row
    assert set(reg) == {"b.txt", "c.html"}
    assert reg["b.txt"].class_label == "neg" and reg["b.txt"].error_cost == 3.0 and reg["c.html"].file_type == "html"
    assert reg["b.txt"].associated_date == dt.date(2012, 2, 2)


def test_tokenize_documents_and_merge(spark, tmpdir_path):
    from wordtally.sources.files import scan_files, to_text

    docs = os.path.join(tmpdir_path, "d")
    os.makedirs(docs)
    with open(os.path.join(docs, "a.txt"), "w") as f:
        f.write("Good film. I don't like it!")
    with open(os.path.join(docs, "b.html"), "w") as f:
        f.write("<p>Bad <b>plot</b>.</p><script>x()</script>")
    with open(os.path.join(docs, "c.pdf"), "wb") as f:
        f.write(b"%PDF")
    reg = spark.createDataFrame(
        [Row(id=i, seq=i, symbol="S", associated_date=dt.date(2012, 1, 1), class_label=lab, error_cost=1.0, success_gain=1.0,
             original_url=os.path.join(docs, n)) for i, (n, lab) in enumerate([("a.txt", "pos"), ("b.html", "neg"), ("c.pdf", "pos"),
                                                                             ("gone.txt", "pos")])]
    )
    tok = {os.path.basename(r.original_url): r for r in R.tokenize_documents(reg, to_text(scan_files(spark, docs))).collect()}
    assert tok["a.txt"].status == "tokenized" and tok["a.txt"].text_tokenized == [["good", "film"], ["do", "not", "like", "it"]]
    assert tok["b.html"].words == ["bad", "plot"] and tok["b.html"].sentences == 1
    assert tok["c.pdf"].status == "unsupported file type" and tok["c.pdf"].tokens == 0
    assert tok["gone.txt"].status == "missing file"
    merged = R.merge_tokenized(R.tokenize_documents(reg, to_text(scan_files(spark, docs))).where(F.col("status") == "tokenized")).first()
    assert (merged.sentences, merged.tokens, merged.parts, merged.class_label) == (3, 8, 2, "neg")


def test_upsert_hot_hash(spark):
    n = 5000
    inc = spark.range(n).select(
        F.col("id"), F.col("id").alias("seq"),
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("u"), F.col("id").cast("string"))).otherwise(F.lit("hot")).alias("orig_md5"),
        F.lit("S").alias("symbol"), F.lit(dt.date(2011, 1, 1)).alias("associated_date"),
        F.when(F.col("id") == n - 1, "neg").otherwise("pos").alias("class_label"), F.lit(1.0).alias("error_cost"),
        F.lit(1.0).alias("success_gain"), F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("original_url"),
        F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("path_saved"), F.lit("txt").alias("file_type"),
        F.lit(False).alias("use_saved"),
    ).repartition(9)
    reg = {r.orig_md5: r for r in R.upsert(None, inc, modify=True).collect()}
    assert len(reg) == 1 + n // 50
    assert (reg["hot"].id, reg["hot"].class_label, reg["hot"].original_url) == (1, "neg", f"{n - 1}.txt")


def test_tokenize_with_stored_block_selector(spark, tmpdir_path):
    from wordtally.sources.files import scan_files

    docs = os.path.join(tmpdir_path, "h")
    os.makedirs(docs)
    for n in ("p1.html", "p2.html"):
        with open(os.path.join(docs, n), "w") as f:
            f.write("<nav>menu words</nav><article>main story here</article>")
    reg = spark.createDataFrame(
        [Row(id=i, seq=i, symbol="S", associated_date=dt.date(2012, 1, 1), class_label="pos", error_cost=1.0, success_gain=1.0,
             original_url=os.path.join(docs, n), xpath=x) for i, (n, x) in enumerate([("p1.html", "article"), ("p2.html", None)])]
    )
    tok = {os.path.basename(r.original_url): r.words for r in R.tokenize_documents(reg, scan_files(spark, docs)).collect()}
    assert tok == {"p1.html": ["main", "story", "here"], "p2.html": ["menu", "wordsmain", "story", "here"]}  # element texts join without a space


def test_manifest_wide_rows_and_many_splits(spark, tmpdir_path):
    """Rows of more than 64 path cells, and files of more than 128 splits, keep every path, order and distinct ids."""
    names = []
    for k in range(2):
        p = os.path.join(tmpdir_path, f"wide{k}.csv")
        names.append(p)
        with open(p, "w", encoding="utf-8") as f:
            f.write("Code;Date;Class Label;Error Cost;Success Gain;Announcement\n")
            for i in range(400):
                cells = [f"f{k}_{i}_{j}.txt" for j in range(70 if i == 7 else 1)]
                f.write(f"S{k};01.01.2012;pos;1;1;" + ";".join(cells) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        wide, rejected = M.read_manifests(spark, names)
        rows = M.announcement_rows(wide).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rejected == [] and len({r.id for r in rows}) == len(rows) == 2 * (399 + 70)
    want = [f"f{k}_{i}_{j}.txt" for k in range(2) for i in range(400) for j in range(70 if i == 7 else 1)]
    assert [r.original_url for r in rows] == want


def test_tokenize_two_contents_of_one_url(spark):
    """Two registry rows of one url are tokenized from their own contents, once each."""
    reg = spark.createDataFrame([(1, "u.txt", "h1", None), (2, "u.txt", "h2", None)], "id long, original_url string, orig_md5 string, xpath string")
    files = spark.createDataFrame([("u.txt", "txt", "h1", bytearray(b"old words")), ("v.txt", "txt", "h2", bytearray(b"new")), ("w.txt", "txt", "h2", bytearray(b"new"))],
                                  "path string, file_type string, orig_md5 string, content binary")
    out = {r.id: r for r in R.tokenize_documents(reg, files).collect()}
    assert out[1].words == ["old", "words"] and out[2].words == ["new"] and len(out) == 2


def test_stamp_touches_only_this_run(spark):
    old = spark.sql("SELECT 'a' orig_md5, TIMESTAMP '2020-01-01' insert_time, TIMESTAMP '2020-01-02' update_time UNION ALL SELECT 'b', TIMESTAMP '2020-01-01', TIMESTAMP '2020-01-02'")
    out = {r.orig_md5: r for r in R.stamp(old.select("orig_md5"), old, True, old.where("orig_md5 = 'a'")).collect()}
    assert out["a"].update_time.year > 2020 and out["b"].update_time.year == 2020 and out["a"].insert_time.year == 2020
