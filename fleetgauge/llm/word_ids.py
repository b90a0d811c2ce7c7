"""Token ids of words, kept by a worker so that a word is encoded once."""

from __future__ import annotations

from itertools import chain

import numpy as np


class WordIds:
    """A table word -> ids. Beyond ``limit`` words those that came again most recently stay, at most half as many."""

    def __init__(self, limit: int):
        self.limit, self.turn = limit, 0
        self.known: dict = {}
        self.flat, self.offset = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int32)  # turn at which a word last came again, 0 for never

    def _trim(self):
        keep = self.used > 0
        if keep.sum() > self.limit // 2:
            keep &= self.used > np.partition(self.used, len(self.used) - self.limit // 2)[len(self.used) - self.limit // 2]
        begin, size = self.offset[:-1][keep], np.diff(self.offset)[keep]
        ends = np.append(0, np.cumsum(size))
        self.flat = self.flat[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        self.offset, self.used = ends, np.zeros(int(keep.sum()), np.int32)
        self.known = {w: i for i, w in enumerate(w for w, k in zip(self.known, keep.tolist(), strict=True) if k)}

    def new(self, split: list[list]) -> list:
        """Words that are not in the table, each once, in order."""
        if len(self.known) > self.limit:
            self._trim()
        return list(dict.fromkeys(chain.from_iterable(set(ws).difference(self.known) for ws in split)))

    def ids(self, split: list[list], new: list, encode, block: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the offsets of the texts, given each text's words. ``encode`` gives ids and offsets of the ``new`` words."""
        before = len(self.known)
        flat, offset = [self.flat], [self.offset]
        for i in range(0, len(new), block):
            part = new[i:i + block]
            ids, at = encode(part)
            n = len(self.known)
            self.known.update(zip(part, range(n, n + len(part)), strict=True))
            flat.append(ids.astype(np.int32))
            offset.append(np.asarray(at[1:]) + offset[-1][-1])
        if new:
            self.flat, self.offset = np.concatenate(flat), np.concatenate(offset)
            self.used = np.append(self.used, np.zeros(len(new), np.int32))
        get = self.known.__getitem__
        index = np.fromiter(map(get, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        self.turn += 1
        self.used[index[index < before]] = self.turn
        begin, size = self.offset[index], self.offset[index + 1] - self.offset[index]
        ends = np.append(0, np.cumsum(size))
        ids = self.flat[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.append(0, np.cumsum([len(ws) for ws in split], dtype=np.int64))]
