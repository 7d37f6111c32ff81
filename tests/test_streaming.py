"""Incremental import: two manifest arrivals, exactly once, registry as a view."""

import os

from pyspark.sql import Row

from wordtally.streaming.incremental import import_stream, registry_view


def _write(path, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.write("Code;Date;Class Label;Error Cost;Success Gain;Announcement\n")
        for r in rows:
            f.write(";".join(r) + "\n")


def test_incremental_import(spark, tmpdir_path):
    mdir = os.path.join(tmpdir_path, "manifests")
    os.makedirs(mdir)
    files = spark.createDataFrame([Row(path="a.txt", orig_md5="h1"), Row(path="b.txt", orig_md5="h1"), Row(path="c.txt", orig_md5="h2")])
    log = os.path.join(tmpdir_path, "log")
    ck = os.path.join(tmpdir_path, "ck")
    _write(os.path.join(mdir, "m1.csv"), [["S", "01.01.2012", "pos", "1", "1", "a.txt"]])
    import_stream(spark, mdir, files, log, checkpoint=ck)
    _write(os.path.join(mdir, "m2.csv"), [["S", "02.01.2012", "neg", "2", "1", "b.txt", "c.txt"]])
    import_stream(spark, mdir, files, log, checkpoint=ck, modify=True)
    import_stream(spark, mdir, files, log, checkpoint=ck)  # nothing new: nothing appended
    raw = spark.read.parquet(log)
    assert raw.count() == 3
    reg = {r.orig_md5: r for r in registry_view(raw).collect()}
    assert set(reg) == {"h1", "h2"}
    # h1 first came with a.txt (stored copy kept); the modify import relabelled it from b.txt
    assert reg["h1"].path_saved.endswith("h1.txt") and reg["h1"].original_url == "b.txt" and reg["h1"].class_label == "neg"
