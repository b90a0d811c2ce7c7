"""Pack documents into sequences of a fixed length along a space-filling curve.

A document's byte trigrams are hashed into a signed vector, which a fixed random
matrix projects to three dimensions; the position of that point on a Hilbert
curve is the sort key, so documents that lie close on the curve read alike. All
documents are range-sorted by (key, id), which also splits a key shared by many
copies, and each partition is one stream of tokens, cut every ``length`` tokens.
The rest of a partition is cut at powers of two, which need no padding.

Null texts are empty and consist of the closing id alone. Repeated rows are
packed each on their own. Columns other than the key are not returned.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import released, slices
from fleetgauge.llm.word_ids import WordIds

DIM, AXES, BITS = 256, 3, 10
#: Words whose ids a worker keeps.
CACHE_WORDS = 800_000
PIECES = "start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long"


# ---- order -------------------------------------------------------------------------------
def vectors(texts: pa.Array) -> np.ndarray:
    """Unit vectors of signed, square-rooted counts of hashed byte trigrams; a text below three bytes is the zero vector."""
    n = len(texts)
    texts = pa.concat_arrays([texts.fill_null("")])
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    arr = np.frombuffer(data, np.uint8)[at[0]:at[-1]].astype(np.uint32) if data is not None and n else np.zeros(0, np.uint32)
    at = at - at[0]
    out = np.zeros((n, DIM))
    if len(arr) > 2:
        h = arr[:-2] | arr[1:-1] << 8 | arr[2:] << 16
        h *= np.uint32(2654435761)
        row = np.repeat(np.arange(0, n * 2 * DIM, 2 * DIM), np.diff(at))
        for back in (1, 2):  # trigrams that start here would end in the next text
            row[np.maximum(at[1:] - back, at[:-1])[at[1:] > at[:-1]]] = n * 2 * DIM
        cell = row[:-2] + (h >> (32 - (2 * DIM).bit_length() + 1))
        both = np.bincount(cell, minlength=(n + 1) * 2 * DIM)[:n * 2 * DIM].reshape(n, DIM, 2)
        diff = both[:, :, 1] - both[:, :, 0]
        out = np.sign(diff) * np.sqrt(np.abs(diff))
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


@functools.cache
def _directions() -> np.ndarray:
    return np.random.default_rng(11).normal(size=(DIM, AXES))


def cells(v: np.ndarray) -> np.ndarray:
    """Grid cells of projected vectors: each axis is squashed to (0, 1) and cut evenly."""
    z = v @ _directions()
    u = 0.5 * (1 + z / np.sqrt(1 + z * z))
    return np.minimum((u * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(cell: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each cell on the Hilbert curve, bit plane by bit plane (Skilling's transpose form)."""
    x = cell.T.copy()
    n = len(x)
    for q in (1 << np.arange(bits - 1, 0, -1)).tolist():
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << np.arange(bits - 1, 0, -1)).tolist():
        t ^= np.where(x[n - 1] & q, q - 1, 0)
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_key(col: str | Column) -> Column:
    """Hilbert key of a text."""
    @F.arrow_udf("long")
    @released
    def key(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [hilbert(cells(vectors(texts[a:b]))) for a, b in slices(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
    return key(F.col(col) if isinstance(col, str) else col)


# ---- tokens ------------------------------------------------------------------------------
class ByteBpe:
    """Ids by the tokenizers library, which sees each word once.

    No token of these models reaches over a single space between two other characters, so texts are cut there.
    """

    CUT = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.words = WordIds(CACHE_WORDS)
        alone = [(t.content, i) for i, t in self.lib.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark, self.mark_id = alone[0] if alone else (None, None)

    @staticmethod
    def _first_apart(words: list[str]) -> list:
        return [(words[0],), *words[1:]]  # the first word has no space before it

    @staticmethod
    def _odd(word) -> bool:
        """Words at whose ends a text must not be cut."""
        w = word[0] if isinstance(word, tuple) else word
        return not w or w[0].isspace() or w[-1].isspace()

    def split(self, text: str) -> list:
        """Words of any text, cut between a space and what is before it only where neither side has more spaces."""
        words = self.CUT.split(text)
        return [(words[0],), *(w[1:] for w in words[1:])]

    def _new(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words; many words go to the library as one text, parted by a token that stands alone."""
        texts = [w[0] if isinstance(w, tuple) else " " + w for w in words]
        got, size = np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        plain = [i for i, t in enumerate(texts) if self.mark and self.mark not in t]
        if plain:
            joined = [self.mark.join([texts[i] for i in plain[j:j + 1000]]) + self.mark for j in range(0, len(plain), 1000)]
            got = np.concatenate([np.array(e.ids, np.int32) for e in self.lib.encode_batch_fast(joined, add_special_tokens=False)])
            size[plain] = np.diff(np.append(-1, np.flatnonzero(got == self.mark_id))) - 1
            got = got[got != self.mark_id]
        rest = sorted(set(range(len(words))).difference(plain))
        if rest:
            ids = [np.array(e.ids, np.int32) for e in self.lib.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)]
            size[rest] = [len(i) for i in ids]
            owner = np.concatenate([np.repeat(plain, size[plain]), np.repeat(rest, size[rest])])
            got = np.concatenate([got, *ids])[np.argsort(owner, kind="stable")]
        return got, np.append(0, np.cumsum(size))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        split = [self._first_apart(t.split(" ")) if t else [] for t in texts]
        new = self.words.new(split)
        odd = {w for w in new if self._odd(w)}
        if odd:
            split = [self.split(t) if not odd.isdisjoint(ws) else ws for t, ws in zip(texts, split, strict=True)]
            new = self.words.new(split)
        return self.words.ids(split, new, self._new)


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteBpe(path)


# ---- packing -----------------------------------------------------------------------------
class Stream:
    """Cuts a partition's tokens into sequences; holds the pieces of the open sequence only."""

    def __init__(self, base: int, length: int):
        self.sequence, self.length, self.filled = base, length, 0
        self.open: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, key, ids: np.ndarray):
        n, start = len(ids), 0
        while start < n:
            take = min(n - start, self.length - self.filled)
            self.open.append((key, start, ids[start:start + take], n))
            start, self.filled = start + take, self.filled + take
            if self.filled == self.length:
                self._close(self.length)

    def _close(self, size: int):
        """Emit the first ``size`` open tokens as a sequence."""
        at = 0
        while at < size:
            key, start, ids, n = self.open.pop(0)
            take = min(len(ids), size - at)
            self.out.append((key, start, take, ids[:take].astype("<u4").tobytes(), n, self.sequence, at))
            if take < len(ids):
                self.open.insert(0, (key, start + take, ids[take:], n))
            at += take
        self.sequence, self.filled = self.sequence + 1, self.filled - size

    def end(self):
        while self.filled:
            self._close(1 << self.filled.bit_length() - 1)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) or [[]] * len(schema)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = 1024, closing: int = 0) -> DataFrame:
    """Pieces (key, start, length, tokens, doc_tokens, sequence_id, offset); ``tokens`` are little-endian 32-bit ids."""
    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).alias("__text"), curve_key(text).alias("__curve"))
    rows = rows.repartitionByRange("__curve", key).sortWithinPartitions("__curve", key)

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        schema = pa.schema([(key, pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("tokens", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
        lib, stream = byte_bpe(path), Stream(TaskContext.get().partitionId() << 40, length)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts = batch.column(1)[a:b].to_pylist()
                place = {t: i for i, t in enumerate(dict.fromkeys(texts))}  # copies lie side by side on the curve
                ids, at = lib.encode(list(place))
                at = at.tolist()
                for k, t in zip(batch.column(0)[a:b].to_pylist(), texts, strict=True):
                    i = place[t]
                    stream.add(k, np.append(ids[at[i]:at[i + 1]], np.int32(closing)))
                yield stream.batch(schema)
        stream.end()
        yield stream.batch(schema)
    return rows.select(key, "__text").mapInArrow(cut, f"{key} long, {PIECES}")
