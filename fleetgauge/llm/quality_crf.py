"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is good or bad. A line is described by its characters,
words and repetition, and by those of the lines next to it; the field adds how
the states of neighbouring lines go together. Forward-backward gives each line
the probability of being good; a document's score is their mean weighted by line
length (bytes plus one).

The field is fitted by gradient ascent on documents whose lines all carry the
document's label, at most ``MAX_DOCS`` a label and ``MAX_LINES`` lines each;
scoring covers every line of every text. A null or empty text is one empty line.
Null labels are not used; without labels of both kinds every score is 0.5.
Repeated rows get equal scores. Other columns are left alone (``score`` is
replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import byte_weights, mix, released, slices

#: Bounds of the training sample: documents of each label, lines of a document.
MAX_DOCS, MAX_LINES = 1500, 1000
STEPS, RATE, RIDGE = 150, 0.05, 1e-3


def _classes() -> np.ndarray:
    """Byte -> 1 upper, 2 digit, 3 space, 4 sentence mark, 5 other sign, 6 beyond ASCII, 0 lower."""
    c = np.zeros(256, np.uint8)
    for b in range(256):
        ch = chr(b)
        c[b] = 6 if b > 127 else 1 if ch.isupper() else 2 if ch.isdigit() else 3 if ch.isspace() or b < 32 else 0 if ch.islower() else 4 if ch in ".,;:'\"-()" else 5
    return c


_CLASS = _classes()
N_BASE = 14


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its weight, offsets of the documents), for all lines of all texts."""
    raw = "\n".join([t or "" for t in texts]) + "\n"
    arr = np.frombuffer(raw.encode("utf-8", "surrogatepass"), np.uint8)
    cls = _CLASS[arr]
    end = np.flatnonzero(arr == 10)
    start = np.append(0, end[:-1] + 1)
    n_lines = np.array([1 + (t.count("\n") if t else 0) for t in texts], np.int64)
    doc_at = np.append(0, np.cumsum(n_lines))
    doc = np.repeat(np.arange(len(texts)), n_lines)
    size = end - start
    share = 1.0 / np.maximum(size, 1)
    f = np.zeros((len(end), N_BASE), np.float64)
    f[:, 0] = np.log1p(size)
    for k in range(1, 7):
        f[:, k] = (np.add.reduceat((cls == k).view(np.uint8), start, dtype=np.int64) - (k == 3)) * share  # the line's own end is a space
    space = cls == 3
    line_of = np.repeat(np.arange(len(end)), size + 1)
    begins = ~space & np.append(True, space[:-1])
    inside = np.flatnonzero(~space)
    ws = np.flatnonzero(begins)
    if len(ws):
        wid = np.cumsum(begins)[inside] - 1
        pos = inside - ws[wid]
        vals = (arr[inside].astype(np.uint64) + np.uint64(1)) * byte_weights()[pos & 63] + (pos >> 6).astype(np.uint64)
        h = mix(np.add.reduceat(vals, np.searchsorted(inside, ws)))
        wl = line_of[ws]
        n_words = np.bincount(wl, minlength=len(end))
        f[:, 7] = np.log1p(n_words)
        f[:, 8] = (size * (1 - f[:, 3])) / np.maximum(n_words, 1) / 10
        same = np.append(False, (h[1:] == h[:-1]) & (wl[1:] == wl[:-1]))
        f[:, 9] = np.bincount(wl, same, len(end)) / np.maximum(n_words, 1)
        key = np.sort(wl.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
        uniq = np.append(True, key[1:] != key[:-1])
        distinct = np.bincount((key[uniq] >> np.uint64(40)).astype(np.int64), minlength=len(end))
        f[:, 10] = 1 - distinct / np.maximum(n_words, 1)
        f[:, 11] = np.log(np.maximum(n_words, 1) / np.maximum(distinct, 1))
        first = np.append(True, wl[1:] != wl[:-1])
        nth = np.arange(len(wl)) - np.maximum.accumulate(np.where(first, np.arange(len(wl)), 0))
        lh = np.zeros(len(end), np.uint64)
        lh[wl[first]] = np.add.reduceat(mix(h + nth.astype(np.uint64) * byte_weights()[0]), np.flatnonzero(first))
        key = doc.astype(np.uint64) << np.uint64(40) | lh >> np.uint64(24)
        again = np.ones(len(end))
        again[np.unique(key, return_index=True)[1]] = 0
        f[:, 12] = again * (lh > 0)
    f[:, 13] = size == 0
    return f, size + 1.0, doc_at


def with_neighbours(f: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
    """A line's own features, those before and after it in its document, whether it is first or last, and a constant."""
    n, d = f.shape
    out = np.zeros((n, 3 * d + 3))
    out[:, :d] = f
    out[1:, d:2 * d], out[:-1, 2 * d:3 * d] = f[:-1], f[1:]
    first, last = doc_at[:-1], doc_at[1:] - 1
    out[first, d:2 * d] = 0
    out[last, 2 * d:3 * d] = 0
    out[first, 3 * d], out[last, 3 * d + 1], out[:, 3 * d + 2] = 1, 1, 1
    return out


def marginals(unary: np.ndarray, trans: np.ndarray, doc_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the expected 2 x 2 transition counts. ``unary`` is each line's score for good over bad.

    Documents are walked side by side, longest first, one line a step.
    """
    n = np.diff(doc_at)
    order = np.argsort(-n, kind="stable")
    at, n = doc_at[:-1][order], n[order]
    e = np.exp(trans - trans.max())
    u = np.clip(unary, -50, 50)
    psi = np.stack([np.full(len(u), 0.5), np.exp(u) * 0.5], axis=1)
    psi /= psi.sum(axis=1, keepdims=True)
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    depth = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(depth), side="left")  # documents with a line at this depth
    for t in range(depth):
        k = live[t]
        a = psi[at[:k] + t] if t == 0 else (alpha[at[:k] + t - 1] @ e) * psi[at[:k] + t]
        alpha[at[:k] + t] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(depth - 2, -1, -1):
        i = at[:live[t + 1]] + t
        nxt = psi[i + 1] * beta[i + 1]
        b = nxt @ e.T
        both = alpha[i][:, :, None] * e[None] * nxt[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[i] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(axis=1), pairs


class Field:
    """Fitted weights."""

    def __init__(self, mean=None, scale=None, w=None, trans=None):
        self.mean, self.scale, self.w, self.trans = mean, scale, w, trans

    @classmethod
    def fit(cls, f: np.ndarray, doc_at: np.ndarray, label: np.ndarray) -> Field:
        """Maximise the mean log-likelihood of the line states; ``label`` has one state a document."""
        if len(set(label.tolist())) < 2:
            return cls()
        mean, scale = f.mean(axis=0), f.std(axis=0) + 1e-6
        x = with_neighbours((f - mean) / scale, doc_at)
        n = np.diff(doc_at)
        y = np.repeat(label.astype(float), n)
        seen = np.zeros((2, 2))
        for s in (0, 1):
            seen[s, s] = (n[label == s] - 1).sum()
        theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
        for step in range(1, STEPS + 1):
            w, trans = theta[:-4], theta[-4:].reshape(2, 2)
            p, pairs = marginals(x @ w, trans, doc_at)
            g = np.append(x.T @ (y - p), (seen - pairs).ravel()) / len(y) - RIDGE * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        return cls(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))

    def lines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of every line, its weight, and the offsets of the documents."""
        f, weight, doc_at = line_features(texts)
        if self.w is None:
            return np.full(len(weight), 0.5), weight, doc_at
        return marginals(with_neighbours((f - self.mean) / self.scale, doc_at) @ self.w, self.trans, doc_at)[0], weight, doc_at

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        p, weight, doc_at = self.lines(texts)
        return np.clip(np.add.reduceat(p * weight, doc_at[:-1]) / np.add.reduceat(weight, doc_at[:-1]), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Field:
    """Fit on a bounded sample, the same for the same rows: the ids with the smallest hashes of each label."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("__label"))
    picked = [known.filter(F.col("__label") == s).orderBy(F.xxhash64(key), key).limit(MAX_DOCS) for s in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))  # at most 2 * MAX_DOCS rows of two numbers

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                texts = part.column(1).to_pylist()
                f, _, at = line_features(texts)
                rows = [f[x:y].astype(np.float32).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(rows, pa.binary())], ["key", "label", "features"])
    short = F.length(F.coalesce(text, F.lit(""))) - F.length(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(""))) < MAX_LINES
    rows = docs.join(ids, key).filter(short).select(F.col(key).cast("string"), F.col(text), "__label")
    got = sorted(tuple(r) for r in rows.mapInArrow(extract, "key string, label int, features binary").collect())
    if not got:
        return Field()
    f = [np.frombuffer(x[2], np.float32).reshape(-1, N_BASE).astype(np.float64) for x in got]
    return Field.fit(np.concatenate(f), np.append(0, np.cumsum([len(x) for x in f])), np.array([x[1] for x in got]))


def score(df: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """Add ``score``, the probability that a document is good."""
    @F.arrow_udf("double")
    @released
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            parts = [field.score(col[a:b].to_pylist()) for a, b in slices(col)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
    return df.withColumn("score", good(F.col(text)))


def label_lines(df: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """Add ``lines``: for every line of the text its probability of being good."""
    @F.arrow_udf("array<double>")
    def lines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            parts = []
            for a, b in slices(col):
                p, _, at = field.lines(col[a:b].to_pylist())
                parts.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(p)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))
    return df.withColumn("lines", lines(F.col(text)))
