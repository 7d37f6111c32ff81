"""Transformations over merged rows: one document per (symbol, date).

A merged document may have any number of parts, so its tokens are never
gathered into one row. Its bag is one aggregation over the tokens of all parts,
keyed by (symbol, date, word) with map-side partial counts; everything a
transformation needs (document frequencies, term frequencies, idf) comes from
that bag and from the merged rows, whose number is bounded by symbols x days.

Negations run over the border of two parts. The greedy joiner is an automaton
with two states (free, or a trigger waits for its word), so a part is a
function of the state before it: the identity, a swap, or a constant. These
functions are composed along the ordered parts, within the partitions of a
range sort and then over the partitions; each part then joins its own tokens,
given the state it starts in.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordtally.functions import text as T
from wordtally.operators.dictionary import DictionaryBuilder, prepared_tokens
from wordtally.operators.joins import checked_broadcast
from wordtally.operators.ranking import join_groups, ordered
from wordtally.operators.registry import in_range, merge_key, merge_tokenized, select_docs
from wordtally.operators.vectorize import Counted, TransformationModel, reduce_features
from wordtally.options import TransformOptions
from wordtally.session import reliable_checkpoint

#: Selected merged rows (id of the tokenization, symbol, associated_date, class_label, error_cost,
#: success_gain, sentences, tokens, parts) and their bag (id, word, tf).
MergedSelection = Counted


def _facts(parts: DataFrame, trigger: str) -> DataFrame:
    """``swap, const`` of each part: it swaps the state, or leaves it at the constant; null and false: it keeps the state.

    The search from the end is a column of its own, as the steps after it read it several times."""
    other = F.array_position(F.transform(F.reverse("words"), lambda w: w != trigger), True)
    rows = parts.withColumns({"_size": F.size("words"), "_other": other}).drop("words")
    rows = rows.withColumn("_run", F.when(F.col("_other") == 0, F.col("_size")).otherwise(F.col("_other") - 1))  # triggers at the end
    size, run = F.col("_size"), F.col("_run")
    swap, const = (run == size) & (size % 2 == 1), F.when(run < size, (run % 2).cast("int"))
    return rows.withColumns({"some": size > 0, "swap": swap.cast("int"), "const": const}).drop("_size", "_other", "_run")


def states(parts: DataFrame, trigger: str) -> DataFrame:
    """``id``, ``waiting`` (a trigger waits before the part) and ``taken`` (a later part takes its last trigger).

    ``parts``: id, seq, words and the merge key; the newest part comes first.
    """
    groups = merge_key()
    # the sort reads its rows twice, the words are read once
    rows = reliable_checkpoint(_facts(parts.select("id", "seq", *groups, "words"), trigger))
    rows = ordered(rows, [F.col("seq").desc(), F.col("id")], groups)
    here = Window.partitionBy("_pid", *groups).orderBy("_mono").rowsBetween(Window.unboundedPreceding, -1)
    # the constant is kept as it would stand before all swaps of its partition
    base = F.col("const").bitwiseXOR(F.col("_swaps") % 2)
    rows = rows.withColumn("_swaps", F.coalesce(F.sum("swap").over(here), F.lit(0)).cast("int")).withColumn("_base", base)
    rows = reliable_checkpoint(rows.withColumn("_last", F.last("_base", ignorenulls=True).over(here)))
    stats = rows.groupBy("_pid", *groups).agg(
        F.sum("swap").alias("s"), F.max_by("_base", F.when(F.col("_base").isNotNull(), F.col("_mono"))).alias("b"),
        F.max(F.when(F.col("some"), F.col("_mono"))).alias("m"),
    )
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_s", F.coalesce(F.sum("s").over(before), F.lit(0)).cast("int"))
    stats = stats.withColumn("b", F.col("b").bitwiseXOR(F.col("_s") % 2))
    stats = stats.select(
        "_pid", *groups, "_s", F.coalesce(F.last("b", ignorenulls=True).over(before), F.lit(0)).alias("_b"),
        F.max("m").over(Window.partitionBy(*groups)).alias("_end"),
    )
    j = join_groups(rows, reliable_checkpoint(stats), ["_pid", *groups])
    swaps = (F.col("_s") + F.col("_swaps")) % 2
    local = F.col("_last").bitwiseXOR(F.col("_s") % 2)
    waiting = F.coalesce(local, F.col("_b")).bitwiseXOR(swaps)
    after = F.coalesce("const", waiting.bitwiseXOR(F.col("swap")))
    taken = F.col("some") & (after == 1) & (F.col("_end") > F.col("_mono"))
    return j.select("id", (waiting == 1).alias("waiting"), F.coalesce(taken, F.lit(False)).alias("taken"))


def join_across_parts(parts: DataFrame, trigger: str) -> DataFrame:
    """X10 over the flattened text of each merged row, part by part: ``words`` with negations joined."""
    flags = states(parts, trigger).groupBy("id").agg(F.collect_list(F.struct("waiting", "taken")).alias("flags"))
    # most parts neither take nor give a word; only the others are looked up, so no words are shuffled to find that out
    some = flags.where((F.size("flags") > 1) | F.exists("flags", lambda f: f["waiting"] | f["taken"]))
    some = reliable_checkpoint(some.select(F.col("id").alias("_id"), F.inline("flags")))
    j = parts.where(F.col("id").isNotNull()).join(checked_broadcast(some), F.col("id") == F.col("_id"), "left").drop("_id")
    j = j.withColumns({"_waiting": F.coalesce("waiting", F.lit(False)) & (F.size("words") > 0), "_taken": F.coalesce("taken", F.lit(False))})
    words, waiting, joined = F.col("words"), F.col("_waiting"), F.col("_joined")
    start = F.when(waiting, F.array(F.concat(F.lit(trigger + " "), F.element_at(words, 1)))).otherwise(F.slice(words, 1, 0))
    j = j.withColumn("_rest", F.when(waiting, F.slice(words, F.lit(2), F.size(words))).otherwise(words))
    # a column for each step, so that the next one reads it and doesn't compute it again
    j = j.withColumn("_joined", F.concat(start, T.join_negations(F.col("_rest"), trigger)))
    kept = F.when(F.col("_taken"), F.slice(joined, F.lit(1), F.size(joined) - 1)).otherwise(joined)
    return j.withColumn("words", kept).drop("waiting", "taken", "_waiting", "_taken", "_rest", "_joined")


def merged_selection(
    tok: DataFrame,
    options: TransformOptions | None = None,
    min_sentences: int = 1,
    start_date: dt.date | str | None = None,
    end_date: dt.date | str | None = None,
    symbols: tuple[str, ...] | list[str] = (),
) -> MergedSelection:
    """F1 on the merged rows of tokenized documents (with ``id``, ``words``, ``seq`` and the merge key).

    Labels, cost and gain are those of the last processed document. The
    selection looks at the merged rows: their label, sum of sentences, date
    and symbol. Date and symbol also prune the documents, as all parts of a
    merged row share them.
    """
    o = options or TransformOptions()
    tok = reliable_checkpoint(tok.where(in_range(start_date, end_date, symbols)))
    merged = merge_tokenized(tok).withColumnRenamed("tokenization_id", "id")
    rows = reliable_checkpoint(select_docs(merged, min_sentences=min_sentences))
    parts = join_across_parts(tok, o.negation_word) if o.neg else tok
    words = prepared_tokens(F.col("words"), o.replace(neg=False), for_dictionary=False)
    counts = parts.select(F.col("symbol").alias("_s"), F.col("associated_date").alias("_d"), F.explode(words).alias("word"))
    counts = counts.groupBy("_s", "_d", "word").agg(F.count(F.lit(1)).alias("tf"))
    key = checked_broadcast(rows.select("id", "symbol", "associated_date"))
    bag = counts.join(key, F.col("_s").eqNullSafe(F.col("symbol")) & F.col("_d").eqNullSafe(F.col("associated_date")))
    return MergedSelection(rows, reliable_checkpoint(bag.select("id", "word", "tf")))


def fit_merged(sel: MergedSelection, options: TransformOptions | None = None) -> TransformationModel:
    """The transformation of a merged selection; ``long_form(sel)``, ``term_counts(sel)`` and ``vectors(sel)`` give
    its samples, of this and of other merged selections. ``options`` must name the same negation rule as the selection."""
    o = options or TransformOptions()
    dm = DictionaryBuilder(o).fit_bag(sel.rows, sel.bag)
    tm = TransformationModel(dm, None, sel.rows.count(), o)
    tm.fit_bag = reliable_checkpoint(tm.bag(sel))
    tm.fit_docs = sel.rows
    if o.tfidf and not o.boolean:
        tm.idf = tm.corpus_idf()
    return reduce_features(tm, sel)
