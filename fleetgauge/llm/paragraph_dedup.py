"""Removal of paragraphs that repeat, exactly or nearly, in other documents.

A paragraph is a line of at least ``min_words`` words and, in a text that has blank
lines, also what stands between two of them, if that is more than one line: a
wrapped paragraph is compared as a whole however it is wrapped. Its five-word
shingles are hashed to a MinHash signature cut into bands; the number of bands and of rows in
a band is tuned so that a pair at the threshold shares a band with the wanted
probability. Equal paragraphs count once; sets so small that only an equal one
reaches the threshold have no bands. Those that share a band meet (see
``linking``) and every link is verified by exact Jaccard similarity; components
of the links are clusters. A paragraph is removed if its cluster has a paragraph in a document
with a smaller key, so every cluster stays whole in its first document.

Passages inside longer paragraphs: a paragraph is also cut into sentences, and
sentences of more than ``LONG`` words behind words chosen by their hash, so that
equal passages are cut alike. A piece is a copy if an earlier document has a piece or a
paragraph with the same set of shingles, or a paragraph in the cluster of that
one; pieces have no bands of their own. Pieces in a row that are all copies are cut out
if they have at least ``passage`` words together.

Texts are cut and shingled once. What is written are places, sets and bands, no
texts; the whole sets of candidates are read again from one document each.

Null texts are empty. Rows with a null key take no part and are kept whole, rows
with equal keys do not remove each other's paragraphs. Shorter lines always stay.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import discard, settle, slices
from fleetgauge.llm.flat_sets import Sets, band_hashes, parity_bitmaps
from fleetgauge.llm.linking import connect
from fleetgauge.llm.ngram_join import FLUSH, PART_BYTES, Packer, _meet

MOST_BANDS, RECALL = 20, 0.999
#: Words of a sentence beyond which it is cut; one word in so many has a cut behind it.
LONG, CHOSEN = 40, 8
#: Bytes of text cut and shingled at a time.
SLICE = 1 << 20
_SENTENCE = re.compile(r"[.!?\u2026]+[\"')\]\u201d\u2019\u00bb]*\s+|[\u3002\uff01\uff1f]+\s*")
_WORD = re.compile(r"\S+\s*")
_PLACE = ("line", "stop", "nth", "words", "at", "end")
#: Places of units; sketches of the sets that a task meets for the first time; bands of these, packed.
_ROWS = ", ".join(f"{c} int" for c in _PLACE) + ", sum long, set_id long, n_shingles long, sketch binary, part int, low binary, place binary, sets binary"
_CUT = "struct<line: int, stop: int, sum: long, at: int, end: int>"


def tune(threshold: float, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the longest bands with which ``most`` of them reach the recall at the threshold, and as few as do."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-threshold ** rows))
        if bands <= most:
            return bands, rows
    return most, 1


@functools.lru_cache(1 << 16)
def _chosen(word: str) -> bool:
    """Whether a long sentence is cut behind the word, which may have spaces behind it."""
    return zlib.crc32(word.strip().lower().encode("utf-8", "surrogatepass")) % CHOSEN == 0


def pieces(p: str) -> list[tuple[int, int]]:
    """(start, stop) of the sentences of a paragraph, the long ones cut at chosen words; together they are all of it."""
    ends = [m.end() for m in _SENTENCE.finditer(p)]
    if not ends or ends[-1] < len(p):
        ends.append(len(p))
    out, a = [], 0
    for b in ends:
        if b - a > 2 * LONG and len(p[a:b].split()) > LONG:
            at = [a, *(m.end() for m in _WORD.finditer(p, a, b) if _chosen(m[0]) and m.end() < b), b]
            out += zip(at[:-1], at[1:], strict=True)
        else:
            out.append((a, b))
        a = b
    return out


def units(t: str, min_words: int) -> Iterator[tuple]:
    """(first line, line after the last, number, words, start, stop, checksum, text) of paragraphs (number -1) and of their pieces.

    Start and stop are places in the text; the checksum is that of the paragraph.
    """
    lines = t.split("\n")
    start = [0]
    for p in lines:
        start.append(start[-1] + len(p) + 1)
    ends = [-1, *(j for j, p in enumerate(lines) if not p.strip()), len(lines)]
    blocks = [(i + 1, j) for i, j in zip(ends[:-1], ends[1:], strict=True) if j > i + 1] if len(ends) > 2 else []
    for j, p in enumerate(lines):
        if (n := len(p.split())) >= min_words:
            yield j, j + 1, -1, n, start[j], start[j + 1] - 1, 0, p
    for j, k in blocks:
        if k - j > 1 and (n := len((p := " ".join(lines[j:k])).split())) >= min_words:
            yield j, k, -1, n, start[j], start[k] - 1, 0, p
    for j, k in blocks or ((j, j + 1) for j in range(len(lines))):
        p = " ".join(lines[j:k]) if k - j > 1 else lines[j]
        if len(cut := pieces(p)) > 1:
            check = zlib.crc32(p.encode("utf-8", "surrogatepass"))
            for i, (x, y) in enumerate(cut):
                if n := len((q := p[x:y]).split()):
                    yield j, k, i, n, start[j] + x, start[j] + y, check, q


def places(docs: DataFrame, key: str, text: str, n: int, bands: int, rows: int, least: int, min_words: int, n_parts: int) -> DataFrame:
    """Rows of three kinds, for one pass over the texts: (key, place, set_id) of every unit, (key, place, set_id, n_shingles,
    sketch) of paragraphs with at least ``least`` shingles whose set the task has not met lately, and the bands of these."""
    kind = dict(docs.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, schema = Packer(n_parts), None
        for batch in batches:
            schema = schema or pa.schema([pa.field(key, batch.schema.field(0).type), *(pa.field(c, pa.int32()) for c in _PLACE), ("sum", pa.int64()), ("set_id", pa.int64()),
                                          ("n_shingles", pa.int64()), ("sketch", pa.binary()), ("part", pa.int32()), ("low", pa.binary()), ("place", pa.binary()), ("sets", pa.binary())])
            for a, b in slices(batch.column(1), SLICE):
                flat, last = [], []  # flat: a list of tuples this long keeps the garbage collector busy
                for t in batch.column(1)[a:b].to_pylist():
                    for u in units(t, min_words):
                        flat += u
                    last.append(len(flat) // 8)
                if not flat:
                    continue
                *cols, check, out = (flat[i::8] for i in range(8))
                who = np.repeat(np.arange(a, b), np.diff(last, prepend=0))
                own = Sets(out, n)
                ids = own.ids()
                sketch = [None] * len(out)
                big = np.flatnonzero((np.array(cols[2]) < 0) & (own.sizes >= least))
                big = np.array([i for i, x in zip(big.tolist(), ids[big].tolist(), strict=True) if not pack.known(x)], np.int64)
                if len(big):
                    tokens, starts = own.take(big)
                    for i, x in zip(big.tolist(), parity_bitmaps(tokens, starts), strict=True):
                        sketch[i] = x
                    met = band_hashes(tokens, starts, bands, rows)
                    pack.hashes.append(met.ravel())
                    pack.owners.append(np.repeat(ids[big], bands))
                    pack.held += met.size
                size = pa.array(own.sizes.astype(np.int64), mask=np.array([x is None for x in sketch]))
                cols = [batch.column(0).take(pa.array(who, pa.int64())), *(pa.array(c, pa.int32()) for c in cols), pa.array(check, pa.int64()), pa.array(ids), size, pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(out), t) for t in schema.types[len(cols):])], schema=schema)
                yield from filed(pack, schema, FLUSH)
        if schema:
            yield from filed(pack, schema, 1)

    def filed(pack: Packer, schema: pa.Schema, least: int) -> Iterator[pa.RecordBatch]:
        for x in pack.flush(least):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(x.num_rows, t) for t in schema.types[:-x.num_columns]), *x.columns], schema=schema)
    return docs.mapInArrow(cut, f"`{key}` {kind}, {_ROWS}")


def _tokens(docs: DataFrame, key: str, text: str, n: int, sets: DataFrame):
    """``tokens`` for ``connect``: whole sets, read again from the place of one paragraph each."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                out = [t[u["at"]:u["end"]] for t, us in zip(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist(), strict=True) for u in us]
                own = Sets(out, n)
                cut = own.offsets.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(own.ids()), pa.array([own.tokens[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["set_id", "tokens"])

    def tokens(ids: DataFrame) -> DataFrame:
        reps = sets.join(ids, "set_id").groupBy(F.col("rep.key").alias("__key")).agg(F.collect_list(F.struct("rep.at", "rep.end")).alias("__at"))  # paragraphs of one document
        return docs.join(reps, F.col(key) == F.col("__key")).select(text, "__at").mapInArrow(make, "set_id long, tokens binary").dropDuplicates(["set_id"])
    return tokens


def _packed() -> list:
    """Places as two numbers: they are what is shuffled most."""
    two = lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))
    return [two(F.shiftleft(F.col("stop") - F.col("line"), 1) + (F.col("nth") < 0).cast("int"), F.greatest("nth", F.lit(0))).alias("__which"),
            two(F.col("at"), F.col("end")).alias("__where"), "words"]


def _unpacked() -> list:
    high, low = lambda c: F.shiftright(c, 32).cast("int"), lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return [(F.col("line") + F.shiftright(high("__which"), 1)).alias("stop"), F.when(high("__which") % 2 == 1, -1).otherwise(low("__which")).alias("nth"), "words",
            high("__where").alias("at"), low("__where").alias("end")]


def repeated(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100, min_words: int = 5, passage: int = 20) -> DataFrame:
    """(key, removed, cut): lines, counted from 0, and passages (line, stop, sum, at, end) to be removed from each document that has any."""
    docs = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key), F.col(text))
    bands, per_band = tune(num / den)
    least = math.ceil(num / max(1, den - num))  # a smaller set and any but an equal one are further apart
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    table = settle(places(docs, key, text, n, bands, per_band, least, min_words, max(1, math.ceil(2 * size / PART_BYTES))), "places")
    rows = table.withColumnRenamed(key, "__key")
    sets = rows.filter("sketch IS NOT NULL").groupBy("set_id").agg(F.min(F.struct(F.col("__key").alias("key"), "at", "end")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    members = rows.filter("part IS NOT NULL").select("part", "low", "place", "sets").groupBy("part").applyInArrow(_meet, "gid long, set_id long").distinct()

    def near(x, y, bits):
        return (np.minimum(x, y) * den >= np.maximum(x, y) * num) & (bits * (den + num) <= (x + y) * (den - num))
    met = settle(members, "met")
    sets = settle(sets.join(met.select("set_id").distinct(), "set_id"), "sets")
    linked = connect(met, sets.select("set_id", "n_shingles", "sketch"), _tokens(docs, key, text, n, sets), near, num, den)

    # a set's first and last document; of sets in clusters, the cluster's; only sets that repeat meet their places
    here = rows.filter("set_id IS NOT NULL")
    each = here.groupBy("set_id").agg(F.min("__key").alias("__low"), F.max("__key").alias("__high"))
    linked = settle(linked.select(F.col("node").alias("set_id"), "root"), "linked")
    # written, so that the places are counted once, their shuffle is gone before they are dealt, and a set with very many places can be split
    each = settle(each.join(linked, "set_id", "left").filter(F.col("root").isNotNull() | (F.col("__high") > F.col("__low"))), "each")
    parts = each.filter("root IS NOT NULL").groupBy("root").agg(F.min("__low").alias("__first"))
    known = each.join(parts, "root").filter(F.col("__high") > F.col("__first")).select("set_id", "__first")
    known = settle(known.union(each.filter("root IS NULL").select("set_id", F.col("__low").alias("__first"))), "known")
    gone = here.select("__key", "line", *_packed(), "sum", "set_id").join(known, "set_id").filter(F.col("__key") > F.col("__first"))
    gone = settle(gone.select("__key", "line", *_unpacked(), "sum"), "gone")
    discard(table)  # by far the largest stage, and read no more
    whole = gone.filter("nth < 0").select("__key", F.explode(F.sequence("line", F.col("stop") - 1)).alias("__line"), F.lit(None).cast(_CUT).alias("__cut"))
    # pieces that follow each other in one paragraph: their number and their rank in it grow alike
    rank = F.row_number().over(Window.partitionBy("__key", "line", "sum").orderBy("nth"))
    run = gone.filter("nth >= 0").repartition("__key", "line", "sum").distinct().withColumn("__run", F.col("nth") - rank).groupBy("__key", "line", "stop", "sum", "__run")
    run = run.agg(F.sum("words").alias("__words"), F.min("at").alias("at"), F.max("end").alias("end")).filter(F.col("__words") >= passage)
    inside = run.select("__key", F.lit(None).cast("int").alias("__line"), F.struct("line", "stop", "sum", "at", "end").cast(_CUT).alias("__cut"))
    return whole.union(inside).groupBy(F.col("__key").alias(key)).agg(F.array_sort(F.collect_set("__line")).alias("removed"), F.array_sort(F.collect_set("__cut")).alias("cut"))


def _apply(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(removed, n_cut, kept): lines that are gone, the number of passages cut from lines that stay, and the text without both."""
    def kept(t: str | None, removed: list[int], cuts: list[dict]) -> dict:
        if t is None or not (removed or cuts):
            return {"removed": removed, "n_cut": 0, "kept": t}
        lines, gone = t.split("\n"), set(removed)
        start = [0]
        for p in lines:
            start.append(start[-1] + len(p) + 1)
        spans: dict[int, list[tuple[int, int]]] = {}
        touched = []
        for c in cuts:  # of this row, not of another one with its key
            if zlib.crc32(" ".join(lines[c["line"]:c["stop"]]).encode("utf-8", "surrogatepass")) == c["sum"]:
                touched.append([])
                for j in range(c["line"], min(c["stop"], len(lines))):
                    if (a := max(c["at"], start[j])) < (b := min(c["end"], start[j + 1] - 1)):
                        spans.setdefault(j, []).append((a - start[j], b - start[j]))
                        touched[-1].append(j)
        out = []
        for j, p in enumerate(lines):
            if j in spans and j not in gone:
                for a, b in sorted(spans[j], reverse=True):
                    p = p[:a] + p[b:]
                p = p.rstrip()
                if not p:
                    gone.add(j)
            if j not in gone:
                out.append(p)
        return {"removed": sorted(gone), "n_cut": sum(not gone.issuperset(js) for js in touched), "kept": "\n".join(out)}
    kind = pa.struct([("removed", pa.list_(pa.int32())), ("n_cut", pa.int64()), ("kept", pa.string())])
    for t, removed, cuts in batches:
        yield pa.array([kept(*x) for x in zip(t.to_pylist(), removed.to_pylist(), cuts.to_pylist(), strict=True)], kind)


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows with their repeated paragraphs and passages taken out, ``n_paragraphs`` (lines), ``removed`` (numbers of the lines that are gone) and ``n_cut`` (passages cut from lines that stay)."""
    gone = repeated(df, key, text, **options).select(F.col(key).alias("__key"), F.col("removed").alias("__removed"), F.col("cut").alias("__cut"))
    out = df.join(gone, F.col(key) == F.col("__key"), "left").drop("__key")
    apply = F.arrow_udf(_apply, "struct<removed: array<int>, n_cut: bigint, kept: string>")
    out = out.withColumn("__out", F.when(F.col("__removed").isNotNull(), apply(text, F.coalesce("__removed", F.array().cast("array<int>")), F.coalesce("__cut", F.array().cast(f"array<{_CUT}>")))))
    n = F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long")
    return out.withColumns({"n_paragraphs": n, "removed": F.coalesce("__out.removed", F.array().cast("array<int>")), "n_cut": F.coalesce("__out.n_cut", F.lit(0).cast("long")),
                            text: F.when(F.col("__out").isNotNull(), F.col("__out.kept")).otherwise(F.col(text))}).drop("__removed", "__cut", "__out")
