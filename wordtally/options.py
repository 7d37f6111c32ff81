"""Transformation options and the document selection (F1).

A config file in the reference's INI layout can be read with
:meth:`TransformOptions.from_config` and :meth:`Selection.from_config`: a
missing or unparsable transformation option falls back to its default, a
missing section is an error.
"""

from __future__ import annotations

import configparser
import datetime as dt
from dataclasses import dataclass, field, fields

SECTION = "Transformations and reductions"
GENERAL = "General"

# Option name in the file -> (our key, type).
OPTION_NAMES = {
    "feature_selection_subset": ("ratio", float),
    "consider_only_presence": ("boolean", bool),
    "consider_negations": ("neg", bool),
    "filter_stopwords": ("stop", bool),
    "min_sentences": ("min_sent", int),
    "min_token_len": ("min_tlen", int),
    "rare_tokens_threshold": ("min_tokens", int),
    "tfidf": ("tfidf", bool),
    "reduction": ("reduction", bool),
    "components": ("components", int),
    "normalize": ("normalize", bool),
    "top_words": ("dict_cut", int),
}


@dataclass(frozen=True)
class TransformOptions:
    ratio: float = 1.0
    boolean: bool = False
    neg: bool = False
    stop: bool = False
    min_sent: int = 1
    min_tlen: int = 3
    min_tokens: int = 3
    tfidf: bool = True
    reduction: bool = False
    components: int = 100
    normalize: bool = False
    dict_cut: int = 0
    # ours: seed of the repeatable sample (Q8), the word that starts a
    # negation (X10), an optional stop word list (F5; None = English list)
    seed: str = "0"
    negation_word: str = "not"
    stopwords: tuple[str, ...] | None = None

    @classmethod
    def from_config(cls, path: str) -> "TransformOptions":
        cp = configparser.ConfigParser()
        with open(path, encoding="utf-8") as fh:
            cp.read_file(fh)
        if not cp.has_section(SECTION):
            raise ValueError(f"config file needs a section '{SECTION}'")
        values = {}
        getters = {float: cp.getfloat, bool: cp.getboolean, int: cp.getint}
        for name, (key, typ) in OPTION_NAMES.items():
            try:
                values[key] = getters[typ](SECTION, name)
            except (configparser.NoOptionError, ValueError):
                pass
        return cls(**values)

    def replace(self, **kw) -> "TransformOptions":
        cur = {f.name: getattr(self, f.name) for f in fields(self)}
        cur.update(kw)
        return TransformOptions(**cur)


def parse_option_date(s: str) -> dt.date:
    """Option dates are ``d/m/Y``."""
    return dt.datetime.strptime(s.strip(), "%d/%m/%Y").date()


@dataclass(frozen=True)
class Selection:
    start_date: dt.date = dt.date(1900, 1, 1)
    end_date: dt.date = dt.date(9999, 12, 31)
    symbols: tuple[str, ...] = field(default_factory=tuple)

    @classmethod
    def from_config(cls, path: str) -> "Selection":
        cp = configparser.ConfigParser()
        with open(path, encoding="utf-8") as fh:
            cp.read_file(fh)
        if not cp.has_section(GENERAL):
            raise ValueError(f"config file needs a section '{GENERAL}'")
        try:
            start = parse_option_date(cp.get(GENERAL, "start_date"))
            end = parse_option_date(cp.get(GENERAL, "end_date"))
        except configparser.NoOptionError as exc:
            raise ValueError("config file needs both start_date and end_date") from exc
        # The symbol list is stripped and split at whitespace
        symbols = tuple(cp.get(GENERAL, "symbols", fallback="").split())
        return cls(start, end, symbols)
