"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of words in which words q apart are identical, q being its
smallest period, that no neighbouring word extends and that holds at least
``times`` periods (three or more) and ``least`` words. Words are runs of bytes other than space
and tab to carriage return.

The factors of every power-of-two length get names: words first, then pairs of
names half a length apart. Where a factor comes again at most its own length L
later, its occurrences within twice the length form an arithmetic progression;
the step q of such a progression is a period. Steps in (L/2, L] are proposed at
length L: there the factor is at least as long as the period, so within a run it
never comes again earlier than one period later, and all places of a run propose
the same step. Places in a row with one step are one run, and it cannot be
extended: had the word before it a partner q later, its place would have been in
the row. Every period lies in one such range, so a run is found at one length
and once; a period that is not the smallest one is never proposed, because the
factor then comes again earlier. Places whose factor has no other place in the
document are left out of all greater lengths, so ordinary text costs two or three
rounds. All documents of a slice of text are worked on together, in flat arrays.

Null texts have no words, as empty ones. Rows with a null key and repeated rows
are treated like any other. Only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import slices

_RUN = "struct<start: bigint, length: bigint, period: bigint>"


def runs_of(ids: np.ndarray, ends: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in flat arrays of word ids; ``ends`` are the places after each document's last word.

    Starts are places in the flat array, in ascending order, ties by period.
    """
    n = len(ids)
    out = [np.zeros((0, 3), np.int64)]
    size = np.diff(np.append(0, ends))
    doc = np.repeat(np.arange(len(ends)), size)
    stop = np.repeat(ends, size)
    name = np.unique(doc * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True)[1]  # equal in one document only
    at, length = np.arange(n), 1  # places that are still followed and the length of the factors that start there
    while len(at):
        order = np.lexsort((at, name))
        same = name[order][1:] == name[order][:-1]
        here, then = at[order][:-1][same], at[order][1:][same]
        step = then - here
        near = (step > length // 2) & (step <= length)
        here, step = here[near], step[near]
        order2 = np.argsort(here)
        here, step = here[order2], step[order2]
        if len(here):
            first = np.flatnonzero(np.append(True, (here[1:] != here[:-1] + 1) | (step[1:] != step[:-1])))
            last = np.append(first[1:], len(here)) - 1
            out.append(np.stack([here[first], here[last] - here[first] + step[first] + length, step[first]], axis=1))
        # a factor twice as long comes again only where this one does, and a longer period needs a longer document
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        full = np.full(n, -1)
        full[at] = name
        keep = again & (at + 2 * length <= stop[at]) & (size[doc[at]] >= times * (length + 1))
        at = at[keep]
        half = full[at + length]
        at, half, left = at[half >= 0], half[half >= 0], full[at][half >= 0]
        name = np.unique(left * np.int64(n + 1) + half, return_inverse=True)[1]
        length *= 2
    found = np.concatenate(out)
    found = found[found[:, 1] >= np.maximum(least, times * found[:, 2])]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found[:, 0], found[:, 1], found[:, 2]


def _slice(texts: list[str | None], least: int, times: int):
    """(words, runs, collapsed text) of each text."""
    split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    known: dict[bytes, int] = {}
    flat = np.fromiter((known.setdefault(w, len(known)) for ws in split for w in ws), np.int64, sum(map(len, split)))
    ends = np.cumsum([len(ws) for ws in split])
    start, length, period = runs_of(flat, ends, least, times)
    gone = np.zeros(len(flat) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    gone = np.cumsum(gone[:-1]) > 0
    cut = np.searchsorted(start, np.append(0, ends))
    for i, ws in enumerate(split):
        a, b, base = cut[i], cut[i + 1], ends[i] - len(ws)
        kept = ws if a == b else [w for w, g in zip(ws, gone[base:ends[i]].tolist(), strict=True) if not g]
        yield len(ws), (start[a:b] - base, length[a:b], period[a:b]), b" ".join(kept).decode("utf-8", "surrogatepass")


def find_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """(key, n_words, runs: array<struct<start, length, period>>, collapsed) of every row.

    Runs stand in order of start, then period; places are word numbers from 0. ``collapsed`` holds the words that no run
    repeats, those of each run's first period among them, joined by one space.
    """
    if times < 3:
        raise ValueError("a factor of up to twice the period has to come again within a run: times must be 3 or more")
    kind = dict(df.dtypes)[key]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                words, runs, kept = zip(*_slice(batch.column(1)[a:b].to_pylist(), least, times), strict=True)
                offset = pa.array(np.append(0, np.cumsum([len(r[0]) for r in runs])).astype(np.int32))
                fields = [pa.array(np.concatenate([r[k] for r in runs]), pa.int64()) for k in range(3)]
                found = pa.ListArray.from_arrays(offset, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(words, pa.int64()), found, pa.array(kept, pa.string())], [key, "n_words", "runs", "collapsed"])
    return df.select(F.col(key), F.col(text).alias("__text")).mapInArrow(scan, f"{key} {kind}, n_words long, runs array<{_RUN}>, collapsed string")


def longest(runs: str = "runs"):
    """The run with the greatest length; ties: smallest start, then period. Null without a run."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-best.start).alias("start"), best.length.alias("length"), (-best.period).alias("period")))
