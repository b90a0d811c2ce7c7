"""Encode and decode with a SentencePiece BPE model, merging many words at once.

Words do not interact: no piece holds a space after another character, so a
text is cut before each run of spaces and every distinct word is encoded once
per worker. Words are encoded together as one flat array of symbols. Each round
looks up the rank of every adjacent pair, takes the smallest per word, merges
its non-overlapping occurrences from the left and compacts the array, until no
word has a pair left. A merge can create a pair of better or equal rank; later
merges of that word then wait for the next round, so the result is that of
merging one pair at a time. Long runs of spaces, whose pieces may all rank
alike, are cut by their period, which is found when the model is loaded.

Null and empty texts give no ids. Rows, repeated or not, are independent; other
columns are left alone.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge.llm.common import slices

NONE = np.int64(1) << 40
#: Words whose ids a worker keeps; the table is emptied when it is full.
CACHE_WORDS = 150_000
SPACE = "▁"


class PairTable:
    """Merged symbol of a pair of symbols, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 5))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] < 0
            at = left[free]
            first = at[np.unique(slot[at], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Merged symbols, -1 where the pair is no piece; negative keys are no pairs."""
        out = np.full(len(keys), -1, np.int32)
        at = np.flatnonzero(keys >= 0)
        want = keys[at]
        slot = self._slot(want)
        while len(at):
            there = self.keys[slot]
            hit = there == want
            out[at[hit]] = self.values[slot[hit]]
            on = (there >= 0) & ~hit
            at, want, slot = at[on], want[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out


class PieceModel:
    """Tables of one model file. BPE with byte fallback, identity normalisation and a leading space, without user-defined pieces."""

    def __init__(self, path: str):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        byte = [lib.is_byte(i) for i in range(n)]
        plain = [i for i in range(n) if not (byte[i] or lib.is_control(i) or lib.is_unknown(i))]
        if sum(byte) != 256 or any(lib.is_unused(i) for i in plain) or any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in plain):
            raise ValueError("the model needs byte fallback and no unused pieces or pieces with inner spaces")
        if lib.encode("é  ﬁ") != lib.encode("é  ﬁ".replace(" ", SPACE)):
            raise ValueError("the model normalises its input")
        score = np.array([lib.get_score(i) for i in range(n)])
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if byte[i]:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        ids = {self.pieces[i]: i for i in plain}
        symbols = dict(ids)
        for p in ids:
            for c in p:
                symbols.setdefault(c, len(self.pieces) + len(symbols))
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, k in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k
        self.span = 2 * max(symbols.values()) + 2
        keys, values = [], []
        for p, k in ids.items():
            for i in range(1, len(p)):
                a, b = symbols.get(p[:i]), symbols.get(p[i:])
                if a is not None and b is not None:
                    keys.append(a * self.span + b)
                    values.append(k)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        self.rank = np.append(rank, NONE)  # the last is read at -1
        # decoding
        self.is_byte = np.array(byte)
        text = [b"" if lib.is_control(i) else " ⁇ ".encode() if lib.is_unknown(i) else bytes([int(self.pieces[i][3:5], 16)]) if byte[i] else self.pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.size = np.array([len(t) for t in text], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.opens = np.array([p.startswith(SPACE) for p in self.pieces])
        self.silent = np.array([lib.is_control(i) for i in range(n)])
        self.period = self._run_period()
        self.clear()

    # ---- words ---------------------------------------------------------------------------
    def clear(self):
        self.known: dict[str, int] = {}
        self.flat, self.offset = [np.zeros(0, np.int32)], [0]
        self._packed = None

    def _run_period(self) -> int:
        """L such that a run of n > L spaces encodes as L spaces and then as a run of n - L; 0 if there is none."""
        runs = [SPACE * n for n in range(1, 81)]
        ids, at = self.encode_words(runs)
        by_len = {n: ids[at[n - 1]:at[n]].tolist() for n in range(1, 81)}
        for size in range(max(len(p) for p in self.pieces if not p.strip(SPACE)), 1, -1):
            if len(by_len[size]) == 1 and all(by_len[n] == by_len[size] + by_len[n - size] for n in range(size + 1, 81)):
                return size
        return 0

    def _ranks(self, sym: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((sym >= 0) & (nxt >= 0), sym.astype(np.int64) * self.span + nxt, -1)
        merged = self.pairs.get(key)
        return merged, self.rank[merged]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and the offsets of the words; words are not empty."""
        text = "".join(words)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym, word, place = self.of_char[chars], np.repeat(np.arange(len(words)), lens), np.arange(len(chars))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            nxt = np.append(sym[1:], -1)
            last = np.append(word[1:] != word[:-1], True)
            nxt[last] = -1
            merged, rank = self._ranks(sym, nxt)
            starts = np.flatnonzero(np.append(True, last[:-1]))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            live = np.repeat(best < NONE, size)
            if not live.all():
                done.append((place[~live], sym[~live]))
                sym, word, place, merged, rank, last = sym[live], word[live], place[live], merged[live], rank[live], last[live]
                if not len(sym):
                    break
                keep = best < NONE
                best, size = best[keep], size[keep]
            take = rank == np.repeat(best, size)
            # of overlapping pairs every second one, from the left
            idx = np.arange(len(sym))
            before = np.maximum.accumulate(np.where(take, -1, idx))
            take &= (idx - before) % 2 == 1
            self._wait(take, sym, last, merged, rank, size)
            at = np.flatnonzero(take)
            sym[at] = merged[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, word, place = sym[stay], word[stay], place[stay]
        place, sym = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        order = np.argsort(place, kind="stable")
        place, sym = place[order], sym[order].astype(np.int64)
        return self._ids(place, sym, chars, lens)

    def _wait(self, take, sym, last, merged, rank, size):
        """Drop merges that follow one which opens a pair of better rank; only words with several merges can have any."""
        owner = np.repeat(np.arange(len(size)), size)
        at = np.flatnonzero(take)
        several = np.bincount(owner[at], minlength=len(size))[owner[at]] > 1
        at = at[several]
        if not len(at):
            return
        own = owner[at]
        new = merged[at]
        left = np.where((at > 0) & (owner[at - 1] == own), sym[at - 1], -1)
        joined = np.append(False, (at[1:] - at[:-1] == 2) & (own[1:] == own[:-1]))
        left[joined] = new[:-1][joined[1:]]
        after = np.minimum(at + 2, len(sym) - 1)
        right = np.where((at + 2 < len(sym)) & (owner[after] == own), sym[after], -1)
        worse = np.minimum(self._ranks(left, new)[1], self._ranks(new, right)[1]) <= rank[at]
        if worse.any():
            total = np.cumsum(worse) - worse
            first = np.append(True, own[1:] != own[:-1])
            base = np.maximum.accumulate(np.where(first, total, 0))
            take[at[total > base]] = False

    def _ids(self, place, sym, chars, lens):
        """Replace symbols that are no pieces by the bytes of their character."""
        plain = (sym >= 0) & (sym < self.n)
        count = np.ones(len(sym), np.int64)
        odd = np.flatnonzero(~plain)
        if len(odd):
            enc = [chr(c).encode("utf-8", "replace") for c in chars[place[odd]].tolist()]
            count[odd] = [len(e) for e in enc]
        ends = np.cumsum(count)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        ids[(ends - count)[plain]] = sym[plain]
        if len(odd):
            raw = np.frombuffer(b"".join(enc), np.uint8)
            c = count[odd]
            ids[np.repeat((ends - count)[odd], c) + np.arange(len(raw)) - np.repeat(np.cumsum(c) - c, c)] = self.byte_ids[raw]
        ends = np.append(0, ends)
        return ids, ends[np.searchsorted(place, np.append(0, np.cumsum(lens)))]

    # ---- texts ---------------------------------------------------------------------------
    def split(self, text: str) -> list[str]:
        """Words of a text, each without its first space."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        words = text.split(" ")
        if "" in words:  # runs of spaces stay with the word after them
            words = [w[1:] for w in re.findall(" +[^ ]+| +", f" {text}")] if text else []
            if self.period:
                words = [p for w in words for p in self._cut(w)]
        return words

    def _cut(self, word: str) -> list[str]:
        spaces = 1 + len(word) - len(word.lstrip(" "))
        k = (spaces - 1) // self.period
        return [" " * (self.period - 1)] * k + [word[k * self.period:]]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the offsets of the texts."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        split = [self.split(t) if t else [] for t in texts]
        new = list(dict.fromkeys(w for ws in split for w in set(ws).difference(self.known)))
        for i in range(0, len(new), 50_000):
            part = new[i:i + 50_000]
            ids, at = self.encode_words([SPACE + w.replace(" ", SPACE) for w in part])
            n = len(self.known)
            self.known.update(zip(part, range(n, n + len(part)), strict=True))
            self.flat.append(ids)
            self.offset.extend((at[1:] + self.offset[-1]).tolist())
            self._packed = None
        if self._packed is None:
            flat = np.concatenate(self.flat)
            self.flat = [flat]
            self._packed = flat, np.array(self.offset, np.int64)
        flat, offset = self._packed
        get = self.known.__getitem__
        index = np.fromiter((k for ws in split for k in map(get, ws)), np.int64, sum(map(len, split)))
        begin, size = offset[index], offset[index + 1] - offset[index]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begin - (ends - size), size) + np.arange(total)]
        words = np.cumsum([len(ws) for ws in split])
        return ids, np.append(0, np.append(0, ends)[words]) if len(split) else np.zeros(1, np.int64)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of the id sequences ``ids[at[k]:at[k + 1]]``."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n):
            raise ValueError("piece id out of range")
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.bytes[np.repeat(self.begin[ids] - (ends - size), size) + np.arange(total)].tobytes()
        ends = np.append(0, ends)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            first = a
            while first < b and self.silent[ids[first]]:
                first += 1
            lo = int(ends[first]) + (1 if first < b and self.opens[ids[first]] else 0)
            part = raw[lo:int(ends[b])]
            try:
                out.append(part.decode())
            except UnicodeDecodeError:
                out.append(self._mend(part))
        return out

    @staticmethod
    def _mend(part: bytes) -> str:
        """Each byte that starts no character becomes a replacement character."""
        out, i = [], 0
        while i < len(part):
            for n in (1, 2, 3, 4):
                try:
                    out.append(part[i:i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                i += 1
        return "".join(out)


@functools.cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(col: str | Column, path: str) -> Column:
    """Piece ids (array<int>) of a text column; null and empty texts give an empty array."""
    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model(path)
        for texts in batches:
            parts = []
            for a, b in slices(texts):
                flat, at = m.encode(texts[a:b].to_pylist())
                parts.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32())))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
    return ids(F.col(col) if isinstance(col, str) else col)


def decode(col: str | Column, path: str) -> Column:
    """Text of a column of piece ids; null gives an empty text, an id outside the model an error."""
    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model(path)
        for lists in batches:
            out = []
            for i in range(0, len(lists), 512):
                part = lists[i:i + 512].fill_null([])
                size = np.diff(part.offsets.to_numpy())
                out += m.decode(part.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size)))
            yield pa.array(out, pa.string())
    return text(F.col(col) if isinstance(col, str) else col)
