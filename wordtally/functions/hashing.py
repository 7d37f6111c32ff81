"""Repeatable pseudo-random decisions from content hashes.

The reference samples with an unseeded generator (Q8). Here a document is in
the sample when the first six hex digits of ``md5(id || seed)``, read as a
number over 2**24, are at most the ratio: the same decision in every engine,
on every executor and after every retry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(1 << 24)


def _digest(id_col: Column, salt: str) -> Column:
    return F.md5(F.concat(id_col.cast("string"), F.lit(salt)))


def hash_fraction(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by (id, seed)."""
    return F.conv(F.substring(_digest(id_col, seed), 1, 6), 16, 10).cast("long") / F.lit(_SCALE)


def in_sample(id_col: Column, ratio: float, seed: str) -> Column:
    """F8: Bernoulli row sampling, kept when the hash fraction <= ratio."""
    return hash_fraction(id_col, seed) <= F.lit(float(ratio))


def random_vote(id_col: Column, seed: str) -> Column:
    """The random baseline, +1 or -1 by the parity of one hash digit."""
    d = F.conv(F.substring(_digest(id_col, "rnd" + seed), 1, 1), 16, 10).cast("int")
    return (F.pmod(d, F.lit(2)) * 2 - 1).cast("int")
