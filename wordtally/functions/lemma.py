"""X8 lemmas as data: a lemma table ``(form, pos_rank, lemma)``.

The reference asks a lexical database for each part of speech in turn (noun,
verb, adjective, adverb) and takes the first answer that changes the word.
No such database ships here, so the lexicon is the corpus vocabulary itself
and candidates come from the suffix-detachment rules below: a candidate
counts when it is a known word, the shortest candidate of a part of speech
wins (rule order breaks ties; an equally long candidate never beats the word
itself), and the lowest part-of-speech rank wins overall. A user lemma table
of the same shape can replace the derived one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values: (part-of-speech rank, suffix, replacement) in rule order;
# 1 noun, 2 verb, 3 adjective (adverbs have no rule).
DETACHMENT_RULES = [
    (1, "s", ""),
    (1, "ses", "s"),
    (1, "xes", "x"),
    (1, "zes", "z"),
    (1, "ches", "ch"),
    (1, "shes", "sh"),
    (1, "men", "man"),
    (1, "ies", "y"),
    (2, "s", ""),
    (2, "ies", "y"),
    (2, "es", "e"),
    (2, "es", ""),
    (2, "ed", "e"),
    (2, "ed", ""),
    (2, "ing", "e"),
    (2, "ing", ""),
    (3, "er", ""),
    (3, "est", ""),
    (3, "er", "e"),
    (3, "est", "e"),
]


def candidates(word: Column) -> Column:
    """array<struct<pos_rank, rule_rank, lemma>> of rule outputs for ``word``."""
    outs = []
    for rank, (pos, suffix, repl) in enumerate(DETACHMENT_RULES):
        cut = word.substr(F.lit(1), F.length(word) - len(suffix))
        outs.append(
            F.when(
                word.endswith(suffix) & (F.length(word) > len(suffix)),
                F.struct(F.lit(pos).alias("pos_rank"), F.lit(rank).alias("rule_rank"), F.concat(cut, F.lit(repl)).alias("lemma")),
            )
        )
    return F.filter(F.array(*outs), lambda s: s.isNotNull())


def lemma_table(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary(word)`` distinct -> ``(form, pos_rank, lemma)``, the chosen
    lemma per form (one row per form that changes)."""
    cand = vocabulary.select(F.col("word").alias("form"), F.explode(candidates(F.col("word"))).alias("c")).select(
        "form", "c.pos_rank", "c.rule_rank", "c.lemma"
    )
    # a candidate counts when it is itself a word of the lexicon (equi join, no pairs)
    known = cand.join(vocabulary.select(F.col("word").alias("lemma")), "lemma", "left_semi").where(
        F.length("lemma") < F.length("form")
    )
    best = known.groupBy("form").agg(
        F.min_by(F.struct("lemma", "pos_rank"), F.struct("pos_rank", F.length("lemma"), "rule_rank")).alias("b")
    )
    return best.select("form", F.col("b.pos_rank").alias("pos_rank"), F.col("b.lemma").alias("lemma"))


def apply_lemmas(docs: DataFrame, table: DataFrame, words_col: str = "words") -> DataFrame:
    """X8 inside the token filter: replace every token of ``words_col`` by its
    lemma when the table ``(form, lemma)`` has one, keeping token order.

    Under the row limit the table is shipped as two sorted columns and looked
    up for whole Arrow batches of token lists, so no token is shuffled. Above
    it the tokens are joined to the table and regrouped by document."""
    from wordtally.operators.joins import broadcast_limit

    if table.count() <= broadcast_limit(table):
        return _in_place(docs, table, words_col)
    others = [c for c in docs.columns if c != words_col]
    toks = docs.select("id", F.posexplode(words_col).alias("_pos", "_tok"))
    lem = table.select(F.col("form").alias("_tok"), F.col("lemma").alias("_lemma"))
    mapped = toks.join(lem, "_tok", "left").select("id", "_pos", F.coalesce("_lemma", "_tok").alias("_w"))
    regrouped = mapped.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_pos", "_w"))).alias("_l"))
    out = docs.select(*others).join(regrouped, "id", "left")
    return out.select(*others, F.coalesce(F.col("_l._w"), F.array().cast("array<string>")).alias(words_col))


#: Documents whose tokens are replaced at once: what a worker holds beside the Arrow batch itself.
LEMMA_ROWS = 1024


def _in_place(docs: DataFrame, table: DataFrame, words_col: str) -> DataFrame:
    found = table.select("form", "lemma").toArrow()
    shipped = docs.sparkSession.sparkContext.broadcast((found["form"].combine_chunks(), found["lemma"].combine_chunks()))
    columns = [*[c for c in docs.columns if c != words_col], words_col]

    def replace(batches):
        yield from _replaced(batches, *shipped.value, columns)

    return docs.select(*columns).mapInArrow(replace, docs.select(*columns).schema)


def _replaced(batches, forms, lemmas, columns: list[str]):
    """Arrow batches of at most LEMMA_ROWS rows, the tokens of the last column replaced."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for whole in batches:
        for at in range(0, whole.num_rows, LEMMA_ROWS):
            batch = whole.slice(at, LEMMA_ROWS)
            lists = batch[columns[-1]]
            tokens = lists.flatten()
            own = tokens.dictionary_encode()
            new = pc.coalesce(lemmas.take(pc.index_in(own.dictionary, value_set=forms)).cast(pa.string()), own.dictionary.cast(pa.string()))
            ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0)).cast(pa.int32())
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
            words = pa.ListArray.from_arrays(offsets, new.take(own.indices))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns[:-1]], words], names=columns)


__all__ = ["DETACHMENT_RULES", "apply_lemmas", "candidates", "lemma_table", "Window"]
