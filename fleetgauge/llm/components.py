"""Connected components of a graph whose links stay distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import settle


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every node to the smallest node it reaches, in place of the links given."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            break
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch reduced to a forest."""
    for batch in batches:
        a, b = forest(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long): the smallest node it is linked to, directly or not.

    Links are contracted within batches, then large-star and small-star steps alternate until nothing changes: each
    moves links towards the smallest neighbour, so paths shorten geometrically. Every round is written to the shared
    folder. Nulls and self-links are ignored; repeated links count once; no links give no rows.
    """
    def clean(df):
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()

    def settled(df):
        out = settle(df, "links")
        return out, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    e, state = settled(clean(links.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").mapInArrow(_forest, "a long, b long")))
    while state[0]:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = clean(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e, now = settled(clean(small))
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
