"""Connected components of a table of links, without collecting links.

Tasks first shrink their links by union-find; what is left is contracted by
alternating star steps, in which every node points to the smallest neighbour
it knows. Each step is a written table, so a lost executor repeats one step,
and the joins read tables, which lets Spark split the rows of a hub.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posthaste.sources.tables import stored

# Links held at once by the union-find of one task.
BLOCK_LINKS = 500_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node that links (a, b) connect them to."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(index[:len(a)].tolist(), index[len(a):].tolist()):
        x, y = find(x), find(y)
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    # Nodes are sorted, so the smallest index is the smallest node.
    roots = np.fromiter((find(x) for x in range(len(nodes))), dtype=np.int64, count=len(nodes))
    inner = roots != np.arange(len(nodes))
    return nodes[inner], nodes[roots[inner]]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a task's links; beyond two blocks of links they leave in parts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def forest() -> tuple[np.ndarray, np.ndarray]:
        return _forest(*(np.concatenate(side) for side in zip(*held)))

    def rows(child: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(child, pa.int64()), pa.array(root, pa.int64())], ["a", "b"])

    count = 0
    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        count += batch.num_rows
        if count >= 2 * BLOCK_LINKS:
            # What was joined so far stays, so that links of one task meet.
            held = [forest()]
            count = len(held[0][0])
            if count >= BLOCK_LINKS:
                yield rows(*held.pop())
                count = 0
    if held:
        yield rows(*forest())


def _is_done(links: DataFrame) -> bool:
    """Whether every node points to one root, and no root points further."""
    ends = links.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("x"))
    nodes = ends.groupBy("x.node").agg(F.sum("x.out").alias("out"), F.max("x.into").alias("into"))
    return nodes.filter("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``links(a long, b long)`` -> ``(node, root)``: every node that is not the
    smallest of its component, and that smallest node.

    Links of a node to itself and null ends are ignored; an empty table gives
    an empty one. The rounds grow with the logarithm of the longest path. Give
    a stored table, as it is read twice.
    """
    known = links.select("a", "b").filter("a != b")
    blocks = math.ceil(known.count() / BLOCK_LINKS)
    # Few links are one block, whose forest is the result; more are dealt to blocks as they are stored.
    held = stored(known.coalesce(max(1, blocks)).mapInArrow(_shrink, "a long, b long"), "links")
    if blocks <= 1:
        return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while not _is_done(held):
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m"))
                       .select("a", F.least("a", "m").alias("m")), "least")
        large = stored(both.join(least, "a").filter("b > a and b != m")
                       .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        held = stored(large.join(least, "a").select(F.inline(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).filter("a != b").distinct(), "links")
    return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
