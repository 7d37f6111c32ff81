"""Quality rules with adaptive thresholds (operator 4).

Each document gets a handful of integer measures. Every (language, source)
has a quantile sketch of each measure: a log-linear histogram of integer
buckets (``common.bucket_of``), whose counts simply add up, so sketches of
sources merge into those of a language and of the corpus. Thresholds are
fences around the quartiles of the sketch, and a join with the thresholds
filters the documents. All arithmetic after the measures is on integers, so
the verdict does not depend on the order of merging.

Defined cases: a null or empty text has no words and fails the base rule; a
null language or source is a group of its own; repeated rows are judged one by
one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordtally.llm.common import Work, bucket_of, ddl_names, map_rows

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"

#: Base rule: fewer words, or a larger share (percent) of words in repeated windows, always fails.
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: A sketch of fewer documents yields to that of its language, then to that of the corpus.
MIN_SKETCH_ROWS = 100
#: Fences lie this many quartile distances outside the quartiles ...
REACH = 3
#: ... each distance counting as at least so many thousandths (a sketch may be all zeros).
LEAST_SPREAD = {"symbols": 50, "dup_lines": 20, "repeats": 120, "word_len": 400}

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, their code points, symbols, duplicate lines, words in repeated 3-word windows) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in _SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line.strip():
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    covered = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, dup, covered


def measures(docs: DataFrame, keep: str = "") -> DataFrame:
    """One row per document with its measures, language, source and, on request, more columns (``keep``: their DDL)."""
    more = ddl_names(keep)

    def run(cols: dict[str, list]) -> dict[str, list]:
        rows = [measure(t) for t in cols["text"]]
        n, chars, symbols, dup, rep = (list(x) for x in zip(*rows)) if rows else ([],) * 5
        return {
            "doc_id": cols["doc_id"], "lang": cols["lang"], "source": cols["source"],
            "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": rep,
            **{c: cols[c] for c in more},
        }

    needed = list(dict.fromkeys(["doc_id", "lang", "source", "text", *more]))
    return map_rows(docs.select(*needed), run, MEASURES + "".join(f", {c} string" for c in ("lang", "source") if c not in more) + (f", {keep}" if keep else ""))


def _rates(m: DataFrame) -> DataFrame:
    """Measures a thousand words, as integers; null without words (such rows take no part in sketches)."""
    cols = {"symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words", "word_len": "word_chars"}
    return m.withColumns({f"r_{k}": F.expr(f"CASE WHEN n_words > 0 THEN ({c} * 1000L) DIV n_words END") for k, c in cols.items()})


def sketches(m: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket) -> count over all documents with words; map-side combined, so a hot source costs nothing extra."""
    stacked = _rates(m).where("n_words > 0").select(
        "lang", "source",
        F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket_of(F.col(f"r_{k}")).alias("bucket")) for k in LEAST_SPREAD])).alias("s"),
    )
    return stacked.groupBy("lang", "source", "s.measure", "s.bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Lower edges of the buckets that hold the quartiles, for each key and measure of a (merged) sketch."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    c = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    q = [F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket"))).alias(f"q{k}") for k in (1, 2, 3)]
    return c.groupBy(*keys, "measure").agg(*q, F.max("total").alias("rows"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source) -> lowest and highest accepted rate of each measure.

    A small sketch yields to the merged one of its language, and that to the
    corpus: the three levels are rolled up from the same bucket counts.
    """
    spread = F.create_map(*[F.lit(x) for kv in LEAST_SPREAD.items() for x in kv])[F.col("measure")]

    def bounds(q: DataFrame, tag: str) -> DataFrame:
        lo = F.col("q1") - REACH * F.greatest(F.col("q2") - F.col("q1"), spread)
        hi = F.col("q3") + REACH * F.greatest(F.col("q3") - F.col("q2"), spread)
        return q.withColumn(f"{tag}_b", F.struct(lo.alias("lo"), hi.alias("hi"))).withColumnRenamed("rows", f"{tag}_rows").drop("q1", "q2", "q3")

    own = bounds(quartiles(sketch, ["lang", "source"]), "own")
    lang = bounds(quartiles(sketch, ["lang"]), "lang").withColumnRenamed("lang", "l_lang").withColumnRenamed("measure", "l_measure")
    # The levels above are joined on their keys; the corpus level has one row per measure.
    every = bounds(quartiles(sketch, []), "all").withColumnRenamed("measure", "a_measure")
    j = own.join(lang, own.lang.eqNullSafe(lang.l_lang) & (own.measure == lang.l_measure))
    j = j.join(F.broadcast(every), j.measure == every.a_measure)
    best = F.when(F.col("own_rows") >= MIN_SKETCH_ROWS, F.col("own_b")).when(F.col("lang_rows") >= MIN_SKETCH_ROWS, F.col("lang_b")).otherwise(F.col("all_b"))
    j = j.select("lang", "source", "measure", best.alias("b"))
    pick = [F.max(F.when(F.col("measure") == k, F.col(f"b.{side}"))).alias(f"{side}_{k}") for k in LEAST_SPREAD for side in ("lo", "hi")]
    return j.groupBy("lang", "source").agg(*pick)


def judge(docs: DataFrame, work: Work, keep: str = "") -> DataFrame:
    """One row per document: measures, ``base_failed``, ``kept`` and the ``keep`` columns.

    The documents are read once; the measures are stored, sketched, and joined
    with the fences of their language and source (a row per group, so the
    engine broadcasts them by their size).
    """
    m = work.store(measures(docs, keep), "rules")
    f = fences(sketches(m)).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    r = _rates(m)
    j = r.join(f, r.lang.eqNullSafe(f.f_lang) & r.source.eqNullSafe(f.f_source), "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    ok = F.col("r_word_len") >= F.col("lo_word_len")
    for k in LEAST_SPREAD:
        ok = ok & (F.col(f"r_{k}") <= F.col(f"hi_{k}"))
    return j.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & F.coalesce(ok, F.lit(False))).alias("kept"),
        *ddl_names(keep),
    )
