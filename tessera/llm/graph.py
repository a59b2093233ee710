"""Connected components of an edge table, without a table of nodes on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import stored


#: Up to so many edges (16 bytes each) are joined in one task; with more, the rounds below are used. Either is exact.
ONE_TASK = 2_000_000


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for the nodes of (a, b), root being the smallest node that can be reached.

    Beyond what one task holds: large-star and small-star in turn (Kiveris et
    al., 2014). Each round halves the distances, minima are aggregated before
    they are joined, and each round's edges are written to the shared folder,
    so lineage stays short.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if e.count() <= one_task:
        return stored(e.coalesce(1).mapInArrow(_in_one_task, "node long, root long"))
    e, last = e.distinct(), None
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("u"))
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        e = stored(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        if now == last:
            return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = now


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if not parts:
        return
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    nodes, own = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = local_components(len(nodes), own[: len(a)], own[len(a) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest element that each of 0..n-1 is joined with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, label[a], low)
        np.minimum.at(fresh, label[b], low)
        fresh = fresh[fresh]
        while (fresh != fresh[fresh]).any():
            fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
