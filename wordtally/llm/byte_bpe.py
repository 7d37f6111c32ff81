"""Byte-level BPE encoding and decoding by backtracking (operator 2).

Bytes are mapped to Latin-1 characters, so an Aho-Corasick automaton over the
vocabulary finds every token of a piece in one pass. The encoder takes the
longest token at each place, checks it against the token before it, falls back
to shorter tokens, and steps back where none fits. Two tokens fit if merging
their bytes by rank gives just these two again; this is memoised for each pair.
A sequence whose neighbours all fit is the one that exact merging produces, and
no place is tried twice, so time is linear in the text.

Defined cases: a null text is encoded as an empty one; a text is encoded whole,
also if it is one very long match of the split pattern; repeated rows are
encoded one by one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from wordtally.llm.common import map_rows, sha256_hex

#: White space as Unicode defines it, which is what ``\s`` means in the split pattern.
_WS = r"\t-\r \x85\xa0  -     　"
#: Runs that no match of the split pattern crosses; most hold one match or two, and repeat.
_CHUNKS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Entries of a worker's memo of chunks; it is emptied when full.
MEMO_ROWS = 500_000


class Codec:
    """Encoder and decoder for a rank file and a split pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.split = regex.compile(pattern)
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self.size = [len(x) for x in self.bytes_of]
        self.fits: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        # tokens that merging never produces are found only as whole pieces
        made, halves = {}, {}
        for token, rank in self.ranks.items():
            parts, pair = self.merge(token)
            if parts == [rank]:
                made[token], halves[rank] = rank, pair
        self.automaton = ahocorasick.Automaton()
        #: the longest other token that begins each token, -1 for none
        self.shorter = [-1] * len(self.bytes_of)
        #: for each token, the growing tokens at its left and at its right edge while it is merged
        self.left: list[tuple[int, ...]] = [()] * len(self.bytes_of)
        self.right: list[tuple[int, ...]] = [()] * len(self.bytes_of)
        for token, rank in sorted(made.items(), key=lambda x: len(x[0])):
            self.automaton.add_word(token.decode("latin-1"), rank)
            self.shorter[rank] = next((made[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in made), -1)
            pair = halves[rank]
            self.left[rank] = (*self.left[pair[0]], rank) if pair else (rank,)
            self.right[rank] = (*self.right[pair[1]], rank) if pair else (rank,)
        self.automaton.make_automaton()
        #: bytes of the longest token
        self.reach = max(map(len, made), default=1)
        #: ranks grow from the parts of a token to the token, as in any trained vocabulary
        self.ordered = all(not p or max(p) < r for r, p in halves.items() if len(self.bytes_of[r]) > 1 and max(map(len, map(self.bytes_of.__getitem__, p))) > 1)

    def merge(self, data: bytes) -> tuple[list[int], tuple[int, int] | None]:
        """Exact merging by rank, quadratic, for short strings: the tokens, and the two that were merged last."""
        parts, pair = [data[i : i + 1] for i in range(len(data))], None
        while len(parts) > 1:
            ranked = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            known = [r for r in ranked if r is not None]
            if not known:
                break
            i = ranked.index(min(known))
            pair = self.ranks[parts[i]], self.ranks[parts[i + 1]]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts], pair

    def fit(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay as they are when their bytes are merged together (memoised)."""
        ok = self.fits.get(a << 32 | b)
        if ok is None:
            if len(self.fits) >= 4 * MEMO_ROWS:
                self.fits.clear()
            ok = self.apart(a, b) if self.ordered else self.merge(self.bytes_of[a] + self.bytes_of[b])[0] == [a, b]
            self.fits[a << 32 | b] = ok
        return ok

    def apart(self, a: int, b: int) -> bool:
        """Follow the merges at the border of a and b in order of rank; false if one across the border comes first."""
        rights, lefts = self.right[a], self.left[b]
        i = j = 0
        last, never = (len(rights) - 1, len(lefts) - 1), 1 << 62
        while True:
            across = self.ranks.get(self.bytes_of[rights[i]] + self.bytes_of[lefts[j]], never)
            grow_a = rights[i + 1] if i < last[0] else never
            grow_b = lefts[j + 1] if j < last[1] else never
            if across < grow_a and across <= grow_b:  # of equal ranks the leftmost is merged first
                return False
            if grow_a == grow_b == never:
                return True
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one match of the split pattern."""
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        latin = piece.decode("latin-1")
        # the longest tokens one after the other are right as far as neighbours fit
        ids: list[int] = []
        before, fits = -1, self.fits
        for _, token in self.automaton.iter_long(latin):
            if ids:
                ok = fits.get(before << 32 | token)
                if not (self.fit(before, token) if ok is None else ok):
                    return self.backtrack(latin, ids, token)
            ids.append(token)
            before = token
        return ids

    def backtrack(self, latin: str, ids: list[int], token: int) -> list[int]:
        """Finish ``ids``, whose neighbours fit, when ``token``, the longest one after them, doesn't."""
        n, size, shorter, fits = len(latin), self.size, self.shorter, self.fits
        longest, reach = self.automaton.iter_long, self.reach
        pos = sum(size[i] for i in ids)
        dead = bytearray(n + 1)
        while True:
            end = pos + size[token]
            ok = not dead[end]
            if ok and ids:
                ok = fits.get(ids[-1] << 32 | token)
                if ok is None:
                    ok = self.fit(ids[-1], token)
            if ok:
                ids.append(token)
                pos = end
                if pos == n:
                    return ids
                token = next(longest(latin[pos : pos + reach]))[1]  # a search of the whole piece would cost its length
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: this place is left for good
                dead[pos] = 1
                last = ids.pop()
                pos -= size[last]
                token = shorter[last]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        memo, packed, split = self.memo, self.packed, self.split.findall
        if len(memo) > MEMO_ROWS:
            memo.clear()
        out = []
        for chunk in _CHUNKS.findall(text):
            ids = memo.get(chunk)
            if ids is None:
                ids = b"".join([packed[i] for p in split(chunk) for i in self.encode_piece(p.encode())])
                if len(chunk) <= 64:
                    memo[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids as binary) of every document, with an exact round trip."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        c = codec(path, pattern)
        ids = [c.encode(t or "") for t in cols["text"]]
        out = {"doc_id": cols["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [sha256_hex(x) for x in ids], "decoded_sha256": [sha256_hex(c.decode(x)) for x in ids]}
        if with_ids:
            out["ids"] = ids
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return map_rows(docs.select("doc_id", "text"), run, schema)
