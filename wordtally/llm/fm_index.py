"""FM-index of a token sequence: suffix order, level-wise wavelet tree, backward search in lock step.

Everything works on numpy arrays, so that many streamed sequences advance by
one token at a time together. Patterns are at most ``REACH`` tokens long, and
suffixes are ordered by that many tokens only.
"""

from __future__ import annotations

import numpy as np

REACH = 32
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletTree:
    """Ranks of symbols in a sequence: one packed bitmap per bit of the alphabet, with running popcounts."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n = len(seq)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        cur = seq
        for k in range(self.levels - 1, -1, -1):
            bit = (cur >> k & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, dtype=np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            word = packed.view(np.uint64)
            count = np.bitwise_count(word).astype(np.int32)
            self.words.append(word)
            self.before.append(np.cumsum(count, dtype=np.int32) - count)
            self.zeros.append(np.int32(self.n - int(count.sum())))
            cur = np.concatenate([cur[~bit], cur[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``at``; ``start`` is its first place in the last level's order."""
        pos, symbol = at.astype(np.int32), symbol.astype(np.int32)
        for k, (word, before, zeros) in enumerate(zip(self.words, self.before, self.zeros)):
            block = pos >> 6
            ones = before[block] + np.bitwise_count(word[block] & _BELOW[pos & 63])
            bit = (symbol & np.int32(1 << (self.levels - 1 - k))) != 0
            pos = np.where(bit, zeros + ones, pos - ones)
        return pos.astype(np.int64) - start

    def starts(self, sigma: int) -> np.ndarray:
        """Place in the last level's order at which each symbol's run begins."""
        symbol = np.arange(sigma, dtype=np.int64)
        return self.rank(symbol, np.zeros(sigma, dtype=np.int64), np.zeros(sigma, dtype=np.int64))


class FMIndex:
    """Index of ``seq`` (symbols from 1; 0 separates and ends sequences)."""

    def __init__(self, seq: np.ndarray, depth: int):
        n = len(seq)
        self.seq, self.depth = seq, depth
        sigma = int(seq.max()) + 1 if n else 1
        # suffix order by doubling: ranks of the first 1, 2, 4, ... tokens
        ranks = [seq.astype(np.int64)]
        size = 1
        while size < REACH:
            r = ranks[-1]
            nxt = np.zeros(n, dtype=np.int64)
            nxt[: max(0, n - size)] = r[size:] + 1
            key = r * (n + 2) + nxt
            order = np.argsort(key)
            step = np.ones(n, dtype=np.int64)
            step[1:] = key[order][1:] != key[order][:-1]
            new = np.empty(n, dtype=np.int64)
            new[order] = np.cumsum(step)
            ranks.append(new)
            size *= 2
        self.sa = order = np.argsort(ranks[-1], kind="stable")
        # longest common prefix with the suffix before, counted up to the depth
        lcp = np.zeros(n, dtype=np.int64)
        a, b = order[1:], order[:-1]
        for k in range(len(ranks) - 2, -1, -1):
            x, y = a + lcp[1:], b + lcp[1:]
            inside = (x < n) & (y < n)
            same = inside & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
            lcp[1:] += same << k
        lcp = np.minimum(lcp, depth)
        # borders of the suffix groups that agree in d tokens
        at = np.arange(n)
        self.left, self.right = [], []
        for d in range(depth + 1):
            new = lcp < d
            new[0] = True
            self.left.append(np.maximum.accumulate(np.where(new, at, 0)).astype(np.int32))
            end = np.append(np.where(new[1:], at[1:], n), n)
            self.right.append(np.minimum.accumulate(end[::-1])[::-1].astype(np.int32))
        self.lcp = np.append(lcp, 0)
        bwt = seq[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.tree = WaveletTree(bwt, sigma)
        self.run = self.tree.starts(sigma)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the suffix intervals of ``symbol`` followed by what the intervals stand for."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]), np.tile(self.run[symbol], 2))
        base = self.first[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]

    def matching_statistics(self, start: np.ndarray, length: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Stream the sequences at ``start`` through the index, right to left.

        For each token: the longest run (up to the depth) starting there that
        occurs at least ``least`` times in the index, and the first suffix of
        its interval. A step that fails falls back to the parent interval.
        """
        n = len(self.seq)
        ms, where = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        lo, hi = np.zeros(len(start), dtype=np.int64), np.full(len(start), n, dtype=np.int64)
        have = np.zeros(len(start), dtype=np.int64)
        lefts, rights = np.stack(self.left), np.stack(self.right)
        for back in range(1, int(length.max(initial=0)) + 1):
            todo = np.nonzero(length >= back)[0]
            at = start[todo] + length[todo] - back
            full = have[todo] == self.depth
            f = todo[full]
            have[f] = self.depth - 1
            lo[f], hi[f] = lefts[self.depth - 1, lo[f]], rights[self.depth - 1, lo[f]]
            sym = self.seq[at]
            fresh = have[todo] == 0  # one token alone: its run of suffixes is known
            t, c = todo[fresh], sym[fresh]
            alone = self.first[c + 1] - self.first[c] >= least
            lo[t], hi[t] = np.where(alone, self.first[c], 0), np.where(alone, self.first[c + 1], n)
            have[t] = alone
            todo, sym = todo[~fresh], sym[~fresh]
            while len(todo):
                l2, h2 = self.extend(sym, lo[todo], hi[todo])
                ok = h2 - l2 >= least
                t = todo[ok]
                lo[t], hi[t], have[t] = l2[ok], h2[ok], have[t] + 1
                todo, sym = todo[~ok], sym[~ok]
                if len(todo):
                    up = np.maximum(self.lcp[lo[todo]], self.lcp[hi[todo]])
                    up = np.minimum(up, have[todo] - 1)
                    lo[todo], hi[todo], have[todo] = lefts[up, lo[todo]], rights[up, lo[todo]], up
                    stuck = up == 0  # back at the token alone
                    t, c = todo[stuck], sym[stuck]
                    alone = self.first[c + 1] - self.first[c] >= least
                    lo[t], hi[t] = np.where(alone, self.first[c], 0), np.where(alone, self.first[c + 1], n)
                    have[t] = alone
                    todo, sym = todo[~stuck], sym[~stuck]
            live = length >= back
            at = start[live] + length[live] - back
            ms[at], where[at] = have[live], lo[live]
        return ms, where
