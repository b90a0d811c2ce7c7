"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (one to
three letters within a word, word ends included), counted over every training
text. A document's own ranking is compared with each profile: an n-gram adds
the distance between its two ranks, or the profile's length where the profile
lacks it. The nearest profile names the language.

Null texts and texts without a letter are ``und`` with score 0, as is any text
when no profile was learned. Training rows without text or language are not
used. Equal counts rank by n-gram, equal distances go to the language that
sorts first, repeated rows get equal results, other columns are left alone
(``lang_pred`` and ``score`` are replaced).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import released, slices

UNKNOWN = "und"
#: Length of a profile and of a document's ranking.
TOP = 400
# an n-gram's code: 20 bits a letter (letters lie below 2**20), 0 a word end, then its length
_SHIFT1, _SHIFT2 = np.int64(20), np.int64(40)
_TWO, _THREE = np.int64(1) << np.int64(60), np.int64(1) << np.int64(61)


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, every run of other characters as one 0, and the offsets of the texts.

    Every text starts and ends with a 0.
    """
    low = [f" {t.lower()} " if t else " " for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    chars = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[chars]
    ends = np.cumsum(size)
    first = np.zeros(len(chars), bool)
    first[ends - size] = True
    keep = letter | np.append(False, letter[:-1]) | first
    chars = np.where(letter, chars, 0)[keep]
    return chars, np.append(0, np.cumsum(keep)[ends - 1]) if len(low) else np.zeros(1, np.int64)


def grams(c: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of a normalised text or of several in a row."""
    a, b, d = c, c[1:], c[2:]
    one = a[a > 0]
    ab = a[:-1] | b << _SHIFT1
    two = ab[(a[:-1] | b) > 0]
    three = (ab[:-1] | d << _SHIFT2)[(b[:-1] > 0) & ((a[:-2] > 0) | (d > 0))]
    return np.concatenate([one, two | _TWO, three | _THREE])


def profiles(df: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, gram, rank) of the ``top`` most frequent n-grams of each language, counted over all rows."""
    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for a, b in slices(batch.column(0)):
                langs = np.array(batch.column(1)[a:b].to_pylist(), object)
                texts = np.array(batch.column(0)[a:b].to_pylist(), object)
                for k in sorted(set(langs.tolist())):
                    g, n = np.unique(grams(normalised(texts[langs == k].tolist())[0]), return_counts=True)
                    if k in total:
                        g = np.concatenate([total[k][0], g])
                        n = np.concatenate([total[k][1], n])
                        g, at = np.unique(g, return_inverse=True)
                        n = np.bincount(at, n, len(g)).astype(np.int64)
                    total[k] = g, n
        for k, (g, n) in total.items():
            for i in range(0, len(g), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(g[i:i + 50_000]), pa.string()), pa.array(g[i:i + 50_000]), pa.array(n[i:i + 50_000], pa.int64())], ["lang", "gram", "n"])
    rows = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("lang", "gram", (F.col("rank") - 1).alias("rank"))  # cut before the shuffle


class Profiles:
    """Profiles side by side: for each known n-gram its rank in every language."""

    def __init__(self, rows, top: int = TOP):
        self.top, self.langs = top, sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.rank = np.full((len(self.grams), len(self.langs)), -1, np.int64)
        col = {k: i for i, k in enumerate(self.langs)}
        if rows:
            self.rank[np.searchsorted(self.grams, [r[1] for r in rows]), [col[r[0]] for r in rows]] = [r[2] for r in rows]

    def distances(self, codes: np.ndarray) -> tuple[np.ndarray, int]:
        """Distance of a text's n-grams to every language, and the most it could be."""
        g, n = np.unique(codes, return_counts=True)
        mine = g[np.argsort(-n, kind="stable")[:self.top]]  # equal counts stay in n-gram order
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        rank = np.where((self.grams[at] == mine)[:, None], self.rank[at], -1)
        place = np.arange(len(mine))[:, None]
        return np.where(rank >= 0, np.abs(rank - place), self.top).sum(axis=0), self.top * len(mine)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Nearest language and its nearness (1: same ranking, 0: no common n-gram)."""
        chars, at = normalised(texts)
        langs, scores = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a < 3 or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            d, most = self.distances(grams(chars[a:b]))
            best = int(d.argmin())
            langs.append(self.langs[best])
            scores.append(max(0.0, 1 - float(d[best]) / most))
        return langs, scores


def fit(df: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> Profiles:
    """Learn profiles; the driver gets ``top`` rows a language."""
    return Profiles([tuple(r) for r in profiles(df, text, lang, top).collect()], top)


def identify(df: DataFrame, learned: Profiles, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``."""
    @F.arrow_udf("struct<lang_pred string, score double>")
    @released
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            langs, scores = [], []
            for a, b in slices(col):
                x, y = learned.predict(col[a:b].to_pylist())
                langs += x
                scores += y
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
    name = "__language"
    out = df.withColumn(name, predict(F.col(text)))
    return out.withColumns({"lang_pred": F.col(f"{name}.lang_pred"), "score": F.col(f"{name}.score")}).drop(name)
