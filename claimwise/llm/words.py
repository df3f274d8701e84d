"""Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text buffers and 64-bit hashes of
words and word n-grams, all in numpy over whole slices of documents.

A word's hash is a polynomial over its bytes modulo 2**64 (read off prefix
sums, so the cost is a few operations a byte) finished by a bit mixer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# The multiplier (any odd 64-bit number) and the mixer of splitmix64.
MULTIPLIER = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

SEGMENT = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(MIX_1)
        x ^= x >> np.uint64(27)
        x *= np.uint64(MIX_2)
        x ^= x >> np.uint64(31)
    return x


def unmix(x: np.ndarray) -> np.ndarray:
    """Inverse of :func:`mix`."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= (x >> np.uint64(31)) ^ (x >> np.uint64(62))
        x *= np.uint64(pow(MIX_2, -1, 2**64))
        x ^= (x >> np.uint64(27)) ^ (x >> np.uint64(54))
        x *= np.uint64(pow(MIX_1, -1, 2**64))
        x ^= (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return x


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER**i and its inverse modulo 2**64, for i below ``n``."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, SEGMENT + 4096)
        up, down = np.full(n, MULTIPLIER, np.uint64), np.full(n, pow(MULTIPLIER, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        pair = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n > 4 * SEGMENT:  # for one huge word; not worth keeping
            return pair
        _powers[:] = pair
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a slice: byte spans [start, end) in the slice's buffer, hash,
    and ``first[d]``: the index of document d's first word (n + 1 entries)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        """The document (its place in the slice) of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(offsets: np.ndarray, raw: np.ndarray, fold_case: bool = False) -> Words:
    """Words of documents at ``offsets`` of ``raw``; none crosses documents.
    ``fold_case`` lower-cases A-Z before hashing."""
    start, end, first = spans(offsets, raw)
    return Words(start, end, hashes(raw, start, end, fold_case), first)


def spans(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) as in :class:`Words`."""
    is_word = WORD[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], is_word[:-1]]) if len(raw) else is_word
    start = np.flatnonzero(is_word & (~before | cut[:-1]))
    after = np.concatenate([is_word[1:], [False]]) if len(raw) else is_word
    end = np.flatnonzero(is_word & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """64-bit hashes of ascending byte spans."""
    out, k = np.empty(len(start), np.uint64), 0
    with np.errstate(over="ignore"):
        while k < len(start):  # a segment of whole words at a time
            a = int(start[k])
            m = max(k + 1, int(np.searchsorted(end, a + SEGMENT, "right")))
            part = raw[a : int(end[m - 1])]
            up, down = powers(len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(BYTE[LOWER[part] if fold_case else part] * up[: len(part)], out=sums[1:])
            s = start[k:m] - a
            out[k:m] = (sums[end[k:m] - a] - sums[s]) * down[s]
            k = m
    return mix(out)


def ngrams(h: np.ndarray, n: int, multiplier: int = MULTIPLIER) -> np.ndarray:
    """Hash of the n-gram that starts at each position of ``h`` (len(h)-n+1
    values, unmixed), built from doubled windows."""
    with np.errstate(over="ignore"):
        if len(h) < n:
            return np.zeros(0, np.uint64)
        m = [pow(multiplier, 1 << i, 2**64) for i in range(n.bit_length())]
        size, window, out, have = 1, h.astype(np.uint64), None, 0
        for i in range(n.bit_length()):
            if n >> i & 1:
                if out is None:
                    out, have = window, size
                else:  # the wider window comes first, what there is so far after it
                    keep = len(h) - have - size + 1
                    out = window[:keep] * np.uint64(pow(multiplier, have, 2**64)) + out[size : size + keep]
                    have += size
            if 2 * size <= n:
                window = window[: len(h) - 2 * size + 1] * np.uint64(m[i]) + window[size:]
                size *= 2
        return out


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """For each of the len - n + 1 n-grams of a slice: whether it stays in one
    document."""
    total = int(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)  # words up to the document's end
    return left[: max(0, total - n + 1)] >= n
