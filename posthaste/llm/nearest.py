"""Exact top-k search by integer inner product, with bounds from coarse to fine.

Vectors are cut into segments. From the means and deviations of two vectors'
segments follows a lower bound of their distance, which is an upper bound of
their inner product: within a segment of ``n`` components it is at most
``n * (mean * mean + deviation * deviation)``. Bounds of few long segments are
computed for all pairs, bounds of shorter ones for those that are left, and
only what survives all levels is scored by its inner product. The first few
candidates of a tile are scored as they are, to have something to compare
bounds with. Where many pairs of a block are left they are taken by a matrix
product of the block, of which only the survivors count. The result is exact.

Queries and candidates meet in tiles: a query goes to every stripe of the
candidates, a candidate to every block of queries; a task holds one block of
queries and the candidates of one Arrow batch.

Nulls and ties: vectors that are null, empty, or hold a null or non-finite
component take no part, nor do rows without vec_id; only vectors of equal
length are compared. Rows with the query's vec_id are its own. Equal scores go
to the smaller vec_id, and repeated candidates count each. An empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Queries that a task holds at once, and candidates of one stripe.
BLOCK_QUERIES = 1024
STRIPE_ROWS = 65_536
# Candidates compared at once, and the first of a tile, which set the first thresholds.
STEP = 4096
FIRST_STEP = 256
# Segments of the levels, for vectors that are long enough.
LEVELS = (4, 16, 48)
# Share of pairs from which on a matrix product of the block is the faster way to their bounds or scores.
DENSE = 0.05


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, embedding)`` -> ``(vec_id, vector)`` with ``floor(scale * x)`` of each component."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
            .filter(F.coalesce(fine, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector")))


def summary(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of segments, scaled so that a dot product is the bound."""
    edges = np.linspace(0, vectors.shape[1], segments + 1).astype(int)
    edges = np.unique(edges)
    lengths = np.diff(edges)
    sums = np.add.reduceat(vectors, edges[:-1], axis=1)
    squares = np.add.reduceat(vectors * vectors, edges[:-1], axis=1)
    means = sums / lengths
    spread = np.sqrt(np.maximum(squares / lengths - means * means, 0.0))
    return np.concatenate([means, spread], axis=1) * np.sqrt(np.tile(lengths, 2))


class _Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.scored = 0
        self.scores = np.zeros((len(ids), 0), dtype=vectors.dtype)
        self.found = np.zeros((len(ids), 0), dtype=np.int64)
        self.levels = ([summary(vectors, n) for n in LEVELS if n < vectors.shape[1]]
                       if vectors.dtype == np.float64 else [])

    def take(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge scored candidates, a row of each per query in ``query``."""
        both = np.concatenate([self.scores[query], scores], axis=1)
        names = np.concatenate([self.found[query], ids], axis=1)
        # By id, then by score; the second sort keeps the first one's order of ties.
        order = np.argsort(names, axis=1, kind="stable")
        both, names = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        order = np.argsort(-both, axis=1, kind="stable")
        both, names = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        both, names = both[:, :self.k], names[:, :self.k]
        if both.shape[1] != self.scores.shape[1]:
            grown = both.shape[1] - self.scores.shape[1]
            empty = np.full((len(self.ids), grown), self.none, dtype=both.dtype)
            self.scores = np.concatenate([self.scores, empty], axis=1)
            self.found = np.concatenate([self.found, np.full(empty.shape, np.iinfo(np.int64).max)], axis=1)
        self.scores[query], self.found[query] = both, names

    @property
    def none(self):
        """Worse than any score."""
        return -np.inf if self.scores.dtype == np.float64 else -(1 << 200)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Candidates that may be among the best of some query."""
        other = self.ids[:, None] != ids[None, :]
        if self.scores.shape[1] == self.k and self.levels:
            other &= self._survivors(vectors, self.scores[:, -1])
        self.scored += int(other.sum())
        if self.scores.dtype != np.float64 or other.mean() > DENSE:
            scores = self.vectors @ vectors.T
            scores[~other] = self.none
            if scores.shape[1] > self.k and scores.dtype == np.float64:
                # Ties at the edge all go on, so that the smaller id can win.
                edge = np.partition(scores, -self.k, axis=1)[:, -self.k]
                count = (scores >= edge[:, None]).sum(axis=1).max()
                keep = np.argpartition(-scores, min(count, scores.shape[1] - 1), axis=1)[:, :count]
                scores, names = np.take_along_axis(scores, keep, 1), ids[keep]
            else:
                names = np.broadcast_to(ids, scores.shape)
            self.take(np.arange(len(self.ids)), scores, names)
            return
        query, row = np.nonzero(other)
        scores = np.einsum("ij,ij->i", self.vectors[query], vectors[row])
        full = self.scores.shape[1] == self.k
        fine = scores >= self.scores[query, -1] if full else np.ones(len(scores), dtype=bool)
        for q in np.unique(query[fine]):
            mine = fine & (query == q)
            self.take(np.array([q]), scores[mine][None, :], ids[row[mine]][None, :])

    def _survivors(self, vectors: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which pairs' bounds reach the k-th best score at every level."""
        going = np.ones((len(self.ids), len(vectors)), dtype=bool)
        # Rounding must not lose a pair.
        needed = least - np.abs(least) * 1e-9 - 1e-6
        for mine, segments in zip(self.levels, LEVELS):
            theirs = summary(vectors, segments)
            if going.mean() > DENSE:
                bounds = mine @ theirs.T
                going &= bounds + np.abs(bounds) * 1e-9 >= needed[:, None]
            else:
                query, row = np.nonzero(going)
                bounds = np.einsum("ij,ij->i", mine[query], theirs[row])
                going[query, row] = bounds + np.abs(bounds) * 1e-9 >= needed[query]
        return going


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """Vectors as doubles where every inner product is exact in them, else as Python integers."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, dim)


def _tile(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    current, queries, best, limit = None, [], None, 0.0

    def rows() -> Iterator[pa.RecordBatch]:
        if best is None or not best.scores.shape[1]:
            return
        # Places that no candidate took, and the query's own row, are worse than any score.
        query, place = np.nonzero((best.found != np.iinfo(np.int64).max) & (best.scores > best.none))
        scores = [max(-2 ** 63, min(2 ** 63 - 1, int(s))) for s in best.scores[query, place]]
        yield pa.record_batch([pa.array(current_keys[query]), pa.array(best.ids[query]),
                               pa.array(best.found[query, place]), pa.array(scores, pa.int64())],
                              ["query_key", "query_id", "vec_id", "score"])

    current_keys = np.zeros(0, dtype=np.int64)
    for batch in batches:
        tiles = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "block", "stripe", "part"))))
        start = 0
        while start < len(tiles):
            end = start
            first = best is None and tiles[start][3] == 1
            while end < len(tiles) and tiles[end] == tiles[start] and end - start < (FIRST_STEP if first else STEP):
                end += 1
            part = batch.slice(start, end - start)
            dim, *_, kind = tiles[start]
            if tiles[start][:3] != current:
                yield from rows()
                current, queries, best = tiles[start][:3], [], None
            if kind == 0:
                queries.append(part)
            elif queries:
                mine = _matrix(part, dim)
                top = float(np.abs(mine.astype(np.float64)).max())
                if best is None:
                    held = np.concatenate([_matrix(q, dim) for q in queries])
                    limit = float(np.abs(held.astype(np.float64)).max())
                    current_keys = np.concatenate([q.column("query_key").to_numpy() for q in queries])
                    exact = limit * limit * dim < 2 ** 53
                    best = _Best(np.concatenate([q.column("vec_id").to_numpy() for q in queries]),
                                 held.astype(np.float64 if exact else object), k)
                if best.vectors.dtype == np.float64 and limit * top * dim >= 2 ** 53:
                    # From here on sums are too large for doubles.
                    wide = _Best(best.ids, np.concatenate([_matrix(q, dim) for q in queries]).astype(object), k)
                    wide.scores = np.array([[int(s) if np.isfinite(s) else wide.none for s in line]
                                            for line in best.scores], dtype=object).reshape(best.scores.shape)
                    wide.found = best.found
                    best = wide
                best.add(part.column("vec_id").to_numpy(), mine.astype(best.vectors.dtype))
            start = end
    yield from rows()


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """``(vec_id, vector)`` of integers, twice -> ``(query_id, rank, vec_id, score)``.

    Equal query rows are one query. A score beyond 64 bits is shown as the
    largest or smallest long.
    """
    asked = queries.select("vec_id", "vector").distinct().withColumn("query_key", F.xxhash64("vec_id", "vector"))
    sizes = {r["kind"]: r["n"] for r in asked.select(F.lit(0).alias("kind")).unionByName(
        candidates.select(F.lit(1).alias("kind"))).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    blocks = max(1, math.ceil(sizes.get(0, 0) / BLOCK_QUERIES))
    slots = candidates.sparkSession.sparkContext.defaultParallelism
    stripes = max(1, math.ceil(sizes.get(1, 0) / STRIPE_ROWS), math.ceil(2 * slots / blocks))

    def dealt(df: DataFrame, part: int, own: str, count: int, other: str, others: int) -> DataFrame:
        return df.select("vec_id", "vector", "query_key", F.size("vector").alias("dim"), F.lit(part).alias("part"),
                         F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(count)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    left = dealt(asked, 0, "block", blocks, "stripe", stripes)
    right = dealt(candidates.withColumn("query_key", F.lit(0).cast("long")), 1, "stripe", stripes, "block", blocks)
    tiles = (left.unionByName(right).repartition(blocks * stripes, "dim", "block", "stripe")
             .sortWithinPartitions("dim", "block", "stripe", "part"))
    found = tiles.mapInArrow(partial(_tile, k=k), "query_key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
