"""Options (2.11, X2, X21), report formatting (X20), sinks (K1-K8), input split."""

import datetime as dt
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wordtally.options import Selection, TransformOptions, parse_option_date


def test_options_defaults_and_fallback(tmpdir_path):
    p = os.path.join(tmpdir_path, "t.cfg")
    with open(p, "w") as f:
        f.write("[General]\nstart_date = 1/2/2011\nend_date = 31/12/2011\nsymbols =  AAA   BBB \n")
        f.write("[Transformations and reductions]\ntop_words = 50\ntfidf = maybe\nconsider_negations = yes\n")
    o = TransformOptions.from_config(p)
    assert o.dict_cut == 50 and o.neg is True and o.tfidf is True  # unparsable -> default
    assert (o.ratio, o.min_tlen, o.min_tokens, o.components) == (1.0, 3, 3, 100)
    s = Selection.from_config(p)
    assert s.start_date == dt.date(2011, 2, 1) and s.end_date == dt.date(2011, 12, 31) and s.symbols == ("AAA", "BBB")
    assert parse_option_date("05/06/2012") == dt.date(2012, 6, 5)
    with open(p, "w") as f:
        f.write("[General]\nstart_date = 1/2/2011\nend_date = 31/12/2011\n")
    with pytest.raises(ValueError):
        TransformOptions.from_config(p)


def test_format_summary(spark):
    from wordtally.operators.evaluate import format_summary, vote_label

    df = spark.createDataFrame([("a", "precision", 1, 0.8567, 0.0123), ("a", "gain", 1, 12.5, 1.25)],
                               "learner string, metric string, cls int, mean double, half_std double")
    got = {r.metric: r.text for r in format_summary(df).collect()}
    assert got == {"precision": " 85.67 (+/-  1.23)%", "gain": " 12.50 (+/-  1.25)"}
    labels = [r.l for r in spark.createDataFrame([(1,), (-1,), (0,)], "v int").select(vote_label(F.col("v")).alias("l")).collect()]
    assert labels == ["pos", "neg", "N/D"]


def test_split_inputs():
    from wordtally.sources.files import split_inputs

    assert split_inputs(["a.TXT", "m.pickle", "b.html"]) == (["a.TXT", "b.html"], ["m.pickle"])
    for bad in (["noext"], ["x.doc"]):
        with pytest.raises(ValueError):
            split_inputs(bad)


def test_sinks(spark, tmpdir_path):
    from wordtally.operators.dictionary import DictionaryBuilder
    from wordtally.operators.registry import stamp, upsert
    from wordtally.sources import sinks

    docs = spark.createDataFrame([Row(id=i, class_label=lab, words=w) for i, (lab, w) in
                                  enumerate([("pos", ["aaa", "bbb"]), ("neg", ["bbb", "ccc"]), ("pos", ["aaa"])])])
    m = DictionaryBuilder(TransformOptions(min_tokens=1)).fit(docs)
    rep = os.path.join(tmpdir_path, "report")
    sinks.write_dictionary_report(m, rep)
    words = spark.read.option("sep", ";").option("header", True).csv(rep + "/words")
    assert sorted(r.Word for r in words.collect()) == ["aaa", "bbb", "ccc"]
    facts = spark.read.option("sep", ";").option("header", True).csv(rep + "/facts").first()
    assert (facts.dictionary_length, facts.documents_processed) == ("3", "3")
    with pytest.raises(Exception):
        sinks.write_dictionary_report(m, rep)  # K7: no overwrite without replace
    sinks.write_dictionary_report(m, rep, replace=True)

    inc = spark.createDataFrame([Row(id=1, seq=1, orig_md5="h", symbol="S", associated_date=dt.date(2011, 1, 1), class_label="pos",
                                     error_cost=1.0, success_gain=1.0, original_url="a.txt", path_saved="store/h.txt",
                                     file_type="txt", use_saved=True)])
    reg = stamp(upsert(None, inc), None)
    r = reg.first()
    assert r.insert_time is not None and r.insert_time == r.update_time
    files = spark.createDataFrame([Row(path="a.txt", orig_md5="h", content=bytearray(b"hi")),
                                   Row(path="b.txt", orig_md5="h", content=bytearray(b"hi"))])
    store = os.path.join(tmpdir_path, "store")
    sinks.store_contents(files, reg, store)
    got = spark.read.parquet(store).collect()
    assert len(got) == 1 and bytes(got[0].content) == b"hi"
    sinks.write_tokenized(spark.createDataFrame([Row(id=1, associated_date=dt.date(2011, 1, 1), tokens=2)]),
                          os.path.join(tmpdir_path, "tok"))
    assert os.path.isdir(os.path.join(tmpdir_path, "tok", "associated_date=2011-01-01"))
