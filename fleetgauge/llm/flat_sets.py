"""Shingle sets of many texts at once, as flat arrays without a loop over texts."""

from __future__ import annotations

import numpy as np

from fleetgauge.llm.common import byte_weights, mix
from fleetgauge.llm.ngram_join import WORDS, _bytes, _powers


class Sets:
    """Sorted distinct hashes of the ``n``-word shingles of every text, one after the other.

    Words are runs of bytes other than space and tab to carriage return, A-Z
    lowered; a text with fewer words is one shingle, one without a word has none.
    """

    def __init__(self, texts: list[str], n: int):
        enc = [t.encode("utf-8", "surrogatepass") for t in texts]
        w, size, begin = _words(enc)
        c = byte_weights()
        count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
        owner = np.repeat(np.arange(len(enc)), count)
        head = np.cumsum(count) - count
        gram = np.zeros(len(w), np.uint64)
        for i in range(min(n, len(w))):
            gram[:len(w) - i] += w[i:] * c[i]
        token = gram[begin[owner] + np.arange(len(owner)) - head[owner]]
        short = np.flatnonzero((size > 0) & (size < n))
        token[head[short]] = size[short]
        for i in range(int(size[short].max(initial=0))):
            k = short[size[short] > i]
            token[head[k]] += w[begin[k] + i] * c[i]
        token = mix(token)
        by = np.argsort(token)  # equal tokens of one text are alike, so this one need not be stable
        by = by[np.argsort(owner[by].astype(np.uint16 if len(enc) <= 1 << 16 else np.int64), kind="stable")]
        token = token[by]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        self.tokens = token[new]
        self.sizes = np.bincount(owner[new], minlength=len(enc))
        self.offsets = np.append(0, np.cumsum(self.sizes))

    def ids(self) -> np.ndarray:
        """Signed 64-bit names of the sets; equal sets have one name."""
        out = np.zeros(len(self.sizes), np.uint64)
        some = np.flatnonzero(self.sizes)
        if len(some):
            out[some] = np.add.reduceat(mix(self.tokens + np.uint64(1)), self.offsets[some]) + self.sizes[some].astype(np.uint64)
        return mix(out).view(np.int64)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, starts) of some of the sets, none of them empty."""
        size = self.sizes[which]
        starts = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(starts, size) + np.repeat(self.offsets[which], size)
        return self.tokens[at], starts


def _words(enc: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the number of words of each text and the place of its first one."""
    flat = np.frombuffer(b" ".join(enc) + b" ", np.uint8)
    start = np.append(0, np.cumsum([len(e) + 1 for e in enc], dtype=np.int64))
    value, parts = _bytes()
    gap = parts[flat]
    first = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    at = np.searchsorted(first, start)
    if not len(first):
        return np.zeros(0, np.uint64), np.diff(at), at[:-1]
    inside = np.flatnonzero(~gap)
    heads = np.searchsorted(inside, first)
    size = np.diff(np.append(heads, len(inside)))
    place = np.arange(len(inside)) - np.repeat(heads, size)
    w = np.add.reduceat(value[flat[inside]] * _powers(1 << int(size.max()).bit_length())[place], heads)
    return mix(w + size.astype(np.uint64)), np.diff(at), at[:-1]


def parity_bitmaps(tokens: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Parity of the tokens hashed to each bit; two bitmaps never differ in more bits than the sets in tokens."""
    bits = 64 * WORDS
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(tokens))))
    n = np.bincount(owner * bits + ((tokens >> np.uint64(20)).astype(np.int64) & (bits - 1)), minlength=len(starts) * bits)
    packed = np.packbits((n & 1).astype(np.uint8).reshape(-1, bits), axis=1, bitorder="little")
    return [x.tobytes() for x in packed]


def band_hashes(tokens: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(set, band): a hash of ``rows`` MinHash values each."""
    rng = np.random.default_rng(17)
    mul = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    weight = rng.integers(1, 1 << 62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.stack([np.minimum.reduceat(tokens * m, starts) for m in mul], axis=1)
    return mix((low.reshape(len(starts), bands, rows) * weight).sum(axis=2, dtype=np.uint64) + mix(np.arange(bands, dtype=np.uint64)))
