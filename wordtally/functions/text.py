"""Tokenizer and token filters as native Column expressions (no Python UDF).

Rules (SURVEY 7.4):
  * sentence end = one of ``. ! ?`` followed by whitespace; surrounding
    whitespace is stripped and an empty text has no sentence;
  * words: ``--`` is a space, a final ``n't`` is split off its word, the
    clitics ``'s 'm 'd 'll 're 've`` are dropped, the text is cut at
    whitespace and ``, ; : ! ? ( ) [ ] { } < > " # $ % & @ * .``;
  * token filter, in this order: ASCII only (X5), lower-case, ``n't`` -> ``not`` (X6),
    keep ``\\w+-?\\w+`` without digits (at least two characters, at most one
    inner hyphen; X7 - it also covers the reference's unused punctuation
    test, X22).

Because sentence ends are always cut points of the word split, the words of a
whole text equal the concatenated words of its sentences; :func:`words` is
therefore applied to whole texts and :func:`sentence_words` only where the
sentence structure is kept.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"\t\n\x0B\f\r "
_SEP_CHARS = _WS + r",;:!?()\[\]{}<>\"#$%&@*."
SEP = f"[{_SEP_CHARS}]"
NON_SEP = f"[^{_SEP_CHARS}]"

_WS_CHARS = "\t\n\x0b\x0c\r "
_SENTENCE_CUT = rf"(?<=[.!?])[{_WS}]+"
# one sentence end per . ! ? directly followed by whitespace
_SENTENCE_END = rf"[.!?](?=[{_WS}])"
_NT = rf"(?i)(?<={NON_SEP})n't(?={SEP}|$)"
_CLITIC = rf"(?i)(?<={NON_SEP})'(?:s|m|d|ll|re|ve)(?={SEP}|$)"
# a maximal run of non-separators that is a word token, or a lone n't
_TOKEN = rf"(?<!{NON_SEP})(?:[A-Za-z_]+-?[A-Za-z_]+|[Nn]'[Tt])(?!{NON_SEP})"

# The classic English stop word list (127 words) used when the
# stop word option is on and no user table is given.
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is "
    "are was were be been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(text: Column | str) -> Column:
    return F.btrim(F.coalesce(_col(text), F.lit("")), F.lit(_WS_CHARS))


def sentence_count(text: Column | str) -> Column:
    """Number of sentences (X3) without building the sentence array: one plus
    the sentence ends inside the stripped text, counted as the length lost
    when they are removed (a single regex pass, no match array)."""
    t = strip_ws(text)
    ends = F.length(t) - F.length(F.regexp_replace(t, _SENTENCE_END, ""))
    return F.when(t == "", F.lit(0)).otherwise(ends + 1).cast("int")


def sentences(text: Column | str) -> Column:
    """array<string> of sentences."""
    t = strip_ws(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _SENTENCE_CUT))


def _prepare(text: Column) -> Column:
    # the rewrites only matter when their trigger occurs: a plain substring
    # test keeps the regex passes off texts without "--" or an apostrophe
    t = F.coalesce(text, F.lit(""))
    t = F.when(t.contains("--"), F.regexp_replace(t, "--", " ")).otherwise(t)
    return F.when(
        t.contains("'"), F.regexp_replace(F.regexp_replace(t, _NT, " n't"), _CLITIC, "")
    ).otherwise(t)


def words(text: Column | str) -> Column:
    """array<string> of filtered, lower-cased word tokens of a text.

    The kept tokens (ASCII only, so X5 holds before any lower-casing) are
    extracted in one regex pass and lower-cased together as one joined ASCII
    string (tokens hold no space); the per-token ``n't`` -> ``not`` step runs
    only on texts that contain an apostrophe."""
    t = _prepare(_col(text))
    raw = F.regexp_extract_all(t, F.lit(_TOKEN), 0)
    low = F.when(F.size(raw) == 0, raw).otherwise(F.split(F.lower(F.array_join(raw, " ")), " "))
    return F.when(t.contains("'"), F.transform(low, lambda x: F.when(x == "n't", F.lit("not")).otherwise(x))).otherwise(low)


def sentence_words(text: Column | str) -> Column:
    """array<array<string>>: the words of each sentence; filtered-out words
    leave their sentence in place (G6 counts it)."""
    return F.transform(sentences(text), lambda s: words(s))


def keep_token(token: Column) -> Column:
    """The X5-X7 filter on single tokens (True when the token is kept)."""
    return token.rlike(r"^[A-Za-z_]+-?[A-Za-z_]+$") | (F.lower(token) == "n't")


def filter_token(token: Column) -> Column:
    """X5-X7 on a single token: the kept form or null."""
    low = F.lower(token)
    return F.when(keep_token(token), F.when(low == "n't", F.lit("not")).otherwise(low))


def join_negations(tokens: Column | str, trigger: str = "not") -> Column:
    """``trigger`` + next token -> one token ``"trigger next"``, greedy from
    the left over the whole (flattened) document; a final trigger stays."""
    tokens = _col(tokens)
    trig = re.escape(trigger)
    marked = F.regexp_replace(
        F.array_join(tokens, " "), f"(^| ){trig} ([^ ]+)", "$1" + trigger.replace("$", "\\$") + "\u0001$2"
    )
    joined = F.transform(F.split(marked, " "), lambda x: F.replace(x, F.lit("\u0001"), F.lit(" ")))
    return F.when(F.size(tokens) == 0, tokens).otherwise(joined)


def remove_stopwords(tokens: Column | str, stopwords: list[str] | None = None) -> Column:
    """F5 against a fixed list carried in the plan."""
    stop = F.array(*[F.lit(w) for w in (stopwords if stopwords is not None else ENGLISH_STOPWORDS)])
    return F.filter(_col(tokens), lambda t: ~F.array_contains(stop, t))


def min_length(tokens: Column | str, n: int) -> Column:
    """keep tokens of at least ``n`` characters (a joined negation counts its space)."""
    return F.filter(_col(tokens), lambda t: F.length(t) >= n)


def flat_tokens(tokens: Column | str) -> Column:
    """X11: sentences -> one token list; passes flat lists through."""
    return F.flatten(_col(tokens))
