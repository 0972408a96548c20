"""Connected components of links.

Large graphs go by alternating large-star and small-star steps (Kiveris et al. 2014): each is a
pre-aggregated minimum by node and a join back on it, so links are never gathered by node, and
the rounds grow with the logarithm of the size. Rounds are cut by checkpoint() in the shared
folder and end when the links no longer change. As soon as no more than `few` links are left
(counted each round), one task finishes them in numpy: 16 bytes a link.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW_LINKS = 2_000_000


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage in the folder of spark.checkpoint.dir; only in local mode (tests) may it be
    unset, which takes a temporary one."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="waymark-"))
    return df.checkpoint(eager=True)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component): labels sink along links, then along themselves."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_ = low != high
        if not open_.any():
            return nodes, nodes[label]
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if parts:
        node, root = roots(*(np.concatenate(p) for p in zip(*parts)))
        for i in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)]), pa.array(root[i : i + (1 << 16)])], names=["node", "root"])


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """links: a, b (long). Returns node, root (the least node of its component) for every node
    that has a link to another one. Nulls link nothing; no links give no rows."""
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = shared_checkpoint(links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())  # a > b
    state = _state(links)
    while state[0] > few:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours of a go to the least of its neighbourhood
        links = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a and its smaller neighbours go to the least of these
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = shared_checkpoint(moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(links)
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(links.select("b", "b").distinct())
    return shared_checkpoint(links.coalesce(1).mapInArrow(_finish, "node long, root long"))
