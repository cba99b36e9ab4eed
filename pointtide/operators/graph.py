"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import cut

__all__ = ["min_labels", "connected_components"]

#: Links that one task may resolve in memory (two longs each); more go through the distributed rounds.
ONE_TASK_LINKS = 2_000_000


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b: the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def _one_task(batches):
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    a, b = t.column(0).to_numpy(), t.column(1).to_numpy()
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = nodes[min_labels(len(nodes), at[: len(a)], at[len(a):])]
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i:i + 100_000]), pa.array(label[i:i + 100_000])], names=["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", one_task_links: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, component) for every node of ``edges`` (two bigint columns); component is its smallest node.

    Nulls are dropped, self loops and repeated edges do no harm, an empty table gives an empty result.
    Up to ``one_task_links`` different links are resolved by one task with a vectorised union; beyond
    that alternating large-star and small-star rounds run over the cluster, each round checkpointed,
    until nothing changes.
    """
    e = (
        edges.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v"))
        .where("u is not null and v is not null")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = cut(e)
    if e.count() <= one_task_links:
        return e.coalesce(1).mapInArrow(_one_task, "node bigint, component bigint")
    nodes = e.select("u").union(e.select("v")).distinct().withColumnRenamed("u", "node")
    links = e.where("u > v")
    before = None
    while True:
        # large star: every larger neighbour of u links to the least of u and its neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        links = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours link to the least of them
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        links = (
            links.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u > v")
            .distinct()
        )
        links = cut(links)
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
