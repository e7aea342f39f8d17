"""Centroid clustering in whole numbers: Lloyd's rounds with heap-ordered bounds, exact at every step.

Vectors become integers and are packed into blocks of ``BLOCK`` rows by the
tasks that read them; a block is one row of a table and never moves. A block
keeps its assignments and, for each cluster, a heap of its vectors ordered by
the gap between the distance to the second nearest centroid (lower bound) and
to their own (upper bound). When centroids move, a gap shrinks by at most the
drift of its own centroid plus the largest drift of another. Instead of
lowering every gap, the heap's offset rises by that sum; only vectors whose
gap lies below the offset are popped, and their distances to all centroids are
computed anew. All others keep their centroid, as the bounds prove.

Each round writes the blocks anew, so a lost executor repeats one round's
tasks. The driver sees the centroids and, per round, one count and one sum per
cluster and component.

Distances are whole numbers, so ties are ties: the smaller cluster number
wins. Gaps are rounded down and drifts up, so that rounding never hides an
expired gap. A vector takes part if it has ``size`` components, none null or
not finite, and none beyond :func:`largest` once scaled, as squared distances
would not fit a long; other vectors have no row in the result. Rows that
repeat a vec_id are vectors of their own; among the first centroids equal
digests go by components. A null vec_id has the digest of ``seed:``. With fewer
vectors than centroids, each vector is one; a table without vectors gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posthaste.llm.columns import by_place
from posthaste.sources.tables import stored

BLOCK = 4096
# What doubles may be off by in a square root or a sum of a few.
ROUNDING = 1e-12
_STATE = ("ids binary, vectors binary, cluster binary, keys binary, places binary, counts binary, sums binary, "
          "popped long")


@dataclass
class _Block:
    ids: bytes
    vectors: np.ndarray
    cluster: np.ndarray
    # Per cluster a heap of (gap plus the cluster's offset when it entered, place in the block).
    heaps: list[list[tuple[float, int]]]


def largest(size: int) -> int:
    """The size of components up to which a squared distance fits a long: 2 ** 27 for 64 components."""
    return min(math.isqrt((1 << 60) // size), (1 << 31) - 1)


def quantized(vectors: DataFrame, scale: int, size: int) -> DataFrame:
    """``(vec_id, x)``: whole components floor(scale * x) of the vectors that take part."""
    placed, [vec_id, embedding] = by_place(vectors, "vec_id", "embedding")
    doubles = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) * scale < largest(size)))
    return placed.filter((F.size(embedding) == size) & fits).select(
        F.col(vec_id).cast("long").alias("vec_id"), doubles.cast("array<int>").alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the ``k`` smallest digests of ``seed:vec_id``, in this order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()
    return np.array([row["x"] for row in first], dtype=np.int64)


def _squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    top = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    # Whole doubles are exact, and their products fast, as long as every sum stays below 2 ** 53.
    kind = np.float64 if 4 * int(top) ** 2 * vectors.shape[1] < 1 << 53 else np.int64
    x, c = vectors.astype(kind), centroids.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def _placed(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number on ties, and the gap to the second nearest."""
    nearest = squares.argmin(axis=1)
    if squares.shape[1] == 1:
        return nearest, np.full(len(squares), np.inf)
    two = np.sqrt(np.partition(squares, 1, axis=1)[:, :2].astype(np.float64))
    return nearest, two[:, 1] - two[:, 0] - ROUNDING * (two[:, 1] + two[:, 0])


def _rescanned(block: _Block, centroids: np.ndarray, offsets: np.ndarray) -> int:
    """Pop the vectors whose gap has expired and place them anew; how many they were."""
    popped: list[int] = []
    for number, heap in enumerate(block.heaps):
        while heap and heap[0][0] <= offsets[number]:
            popped.append(heapq.heappop(heap)[1])
    if popped:
        places = np.array(popped)
        nearest, gap = _placed(_squares(block.vectors[places], centroids))
        block.cluster[places] = nearest
        for place, number, key in zip(popped, nearest.tolist(), (gap + offsets[nearest]).tolist()):
            heapq.heappush(block.heaps[number], (key, place))
    return len(popped)


def _filled(ids: list, vectors: np.ndarray, centroids: np.ndarray) -> _Block:
    """A new block: every vector is placed, and a sorted list is a heap."""
    nearest, gap = _placed(_squares(vectors, centroids))
    order = np.argsort(gap, kind="stable")
    heaps = [[(float(gap[i]), int(i)) for i in order[nearest[order] == c]] for c in range(len(centroids))]
    present = np.array([i is not None for i in ids])
    numbers = np.array([i or 0 for i in ids], dtype=np.int64)
    return _Block(present.tobytes() + numbers.tobytes(), vectors, nearest.astype(np.int32), heaps)


def _row(block: _Block, k: int, popped: int) -> pa.RecordBatch:
    """A block as a row, with the number and the sum of the vectors of each cluster."""
    member = np.arange(k)[:, None] == block.cluster
    counts = member.sum(axis=1)
    # Sums of a block's whole numbers stay far below 2 ** 53.
    sums = (member.astype(np.float64) @ block.vectors.astype(np.float64)).astype(np.int64)
    keys = np.array([key for heap in block.heaps for key, _ in heap], dtype=np.float64)
    places = np.array([place for heap in block.heaps for _, place in heap], dtype=np.int32)
    values = [block.ids, block.vectors.tobytes(), block.cluster.tobytes(), keys.tobytes(), places.tobytes(),
              counts.astype(np.int64).tobytes(), sums.tobytes()]
    return pa.record_batch([*[pa.array([v], pa.binary()) for v in values], pa.array([popped], pa.int64())],
                           ["ids", "vectors", "cluster", "keys", "places", "counts", "sums", "popped"])


def _read(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[_Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            value = {name: batch.column(name)[row].as_py() for name in ("ids", "vectors", "cluster", "keys", "places")}
            cluster = np.frombuffer(value["cluster"], dtype=np.int32).copy()
            ordered = zip(np.frombuffer(value["keys"], dtype=np.float64).tolist(),
                          np.frombuffer(value["places"], dtype=np.int32).tolist())
            heaps = [[next(ordered) for _ in range(n)] for n in np.bincount(cluster, minlength=k).tolist()]
            yield _Block(value["ids"], np.frombuffer(value["vectors"], dtype=np.int32).reshape(-1, size), cluster, heaps)


def _pack(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, size = centroids.shape
    ids: list = []
    parts: list[np.ndarray] = []

    def blocks(least: int) -> Iterator[pa.RecordBatch]:
        nonlocal ids, parts
        if len(ids) < least or not ids:
            return
        held = np.concatenate(parts)
        whole = len(ids) // least * least if least > 1 else len(ids)
        for start in range(0, whole, BLOCK):
            stop = min(start + BLOCK, whole)
            yield _row(_filled(ids[start:stop], held[start:stop], centroids), k, stop - start)
        ids, parts = ids[whole:], [held[whole:]]

    for batch in batches:
        ids += batch.column("vec_id").to_pylist()
        flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
        parts.append(flat.astype(np.int32).reshape(-1, size))
        yield from blocks(BLOCK)
    yield from blocks(1)


def _round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, size = centroids.shape
    for block in _read(batches, k, size):
        popped = _rescanned(block, centroids, offsets)
        yield _row(block, k, popped)


def _final(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, size = centroids.shape
    for block in _read(batches, k, size):
        n = len(block.cluster)
        present = np.frombuffer(block.ids, dtype=bool, count=n)
        numbers = np.frombuffer(block.ids[n:], dtype=np.int64)
        apart = block.vectors.astype(np.int64) - centroids[block.cluster]
        yield pa.record_batch([pa.array(numbers, pa.int64(), mask=~present), pa.array(block.cluster, pa.int32()),
                               pa.array((apart * apart).sum(axis=1), pa.int64())], ["vec_id", "cluster", "distance"])


def _totals(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    """Vectors and component sums per cluster of a task's blocks."""
    counts = np.zeros(k, dtype=np.int64)
    sums = np.zeros((k, size), dtype=np.int64)
    for batch in batches:
        for n, total in zip(batch.column("counts").to_pylist(), batch.column("sums").to_pylist()):
            counts += np.frombuffer(n, dtype=np.int64)
            sums += np.frombuffer(total, dtype=np.int64).reshape(k, size)
    used = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64()),
                           pa.array(list(sums[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of the clusters' vectors; an empty cluster stays."""
    k, size = centroids.shape
    parts = blocks.select("counts", "sums").mapInArrow(
        partial(_totals, k=k, size=size), "cluster int, n long, sums array<long>")
    each = F.posexplode("sums").alias("component", "part")
    found = (parts.select("cluster", "n", each).groupBy("cluster", "component")
             .agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect())
    moved = centroids.copy()
    for row in found:
        moved[row["cluster"], row["component"]] = int(row["total"]) // row["n"]
    return moved


def _risen(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each cluster its own drift plus the largest drift of another, rounded up."""
    apart = (new - old).astype(np.float64)
    drift = np.sqrt((apart * apart).sum(axis=1)) * (1 + ROUNDING)
    others = np.array([np.delete(drift, c).max(initial=0.0) for c in range(len(drift))])
    return (drift + others) * (1 + ROUNDING)


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64,
              size: int = 64) -> tuple[DataFrame, np.ndarray, list[int]]:
    """``(vec_id, cluster, distance)`` of every vector that takes part, the last
    centroids, and how many vectors were scanned at each assignment."""
    rows = quantized(vectors, scale, size)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        empty = rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter("false")
        return empty, centroids.reshape(0, size), []
    blocks = stored(rows.mapInArrow(partial(_pack, centroids=centroids), _STATE), "blocks")
    offsets = np.zeros(len(centroids))
    scanned = [blocks.agg(F.sum("popped")).first()[0]]
    for _ in range(rounds):
        moved = _moved(blocks, centroids)
        offsets = offsets * (1 + ROUNDING) + _risen(centroids, moved)
        centroids = moved
        blocks = stored(blocks.mapInArrow(partial(_round, centroids=centroids, offsets=offsets), _STATE), "blocks")
        scanned.append(blocks.agg(F.sum("popped")).first()[0])
    placed = blocks.mapInArrow(partial(_final, centroids=centroids), "vec_id long, cluster int, distance long")
    return placed, centroids, scanned


def centroid_digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]


def with_totals(placed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add the summed distance of each vector's cluster and of all, and the digest of its centroid."""
    placed = stored(placed, "placed")
    sums = {row["cluster"]: row["total"] for row in
            placed.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digests = centroid_digests(centroids)
    # One row per cluster.
    each = placed.sparkSession.createDataFrame(
        [(c, sums.get(c, 0), sum(sums.values()), digest) for c, digest in enumerate(digests)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(each), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
