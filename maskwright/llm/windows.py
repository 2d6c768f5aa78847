"""Hashes of word windows of one text: grams, minimizers and runs of windows that share one."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of a window, and of the grams among which each window picks its least hash.
WINDOW, GRAM = 50, 25
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse, at least ``n`` of them."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        base = int(_BASES[which])
        size = max(1 << 14, 1 << (n - 1).bit_length())
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of ``x`` over all bits (a bijection on 64 bits)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hash of each word; remembers a bounded number of them."""

    room = 400_000

    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(self) < self.room:
            self[w] = h
        return h


class Text:
    """Prefix sums over one text's words, from which any stretch is hashed in one step."""

    def __init__(self, words: list[bytes], memo: Words):
        self.n = n = len(words)
        self.h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
        self.sums: list[np.ndarray | None] = [None, None]

    def _sum(self, which: int) -> np.ndarray:
        if self.sums[which] is None:
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(self.h * _power(which, self.n + 1)[0][: self.n], out=s[1:])
            self.sums[which] = s
        return self.sums[which]

    def stretch(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Hash of words start..end-1; equal stretches have equal hashes wherever they are."""
        s = self._sum(which)
        return mix((s[end] - s[start]) * _power(which, self.n + 1)[1][start] + (end - start).astype(np.uint64))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window of each run of windows with one minimizer, and its hash.

        A window's minimizer is the leftmost least hash of its grams, so it depends on the
        window's words alone: equal windows have equal minimizers.
        """
        if self.n < WINDOW:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64)
        at = np.arange(self.n - GRAM + 1)
        g = self.stretch(at, at + GRAM, 0)
        span = WINDOW - GRAM + 1
        least = np.lib.stride_tricks.sliding_window_view(g, span).argmin(1) + np.arange(self.n - WINDOW + 1)
        first = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
        last = np.concatenate([first[1:] - 1, [len(least) - 1]])
        return first, last, g[least[first]]
