"""Means of vectors per key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numbers of one frame of partial sums that leaves a task at a time.
NUMBERS_AT_ONCE = 1 << 20


def _sums(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The distinct keys of a batch in order of appearance, their weights and their sums."""
    rows = pa.Table.from_arrays(
        [*[batch.column(k) for k in keys], pa.array(np.arange(batch.num_rows))], names=[*keys, "_row"])
    groups = rows.group_by(list(keys), use_threads=False).aggregate([("_row", "list")])
    members = groups.column("_row_list").combine_chunks()
    order, starts = members.flatten().to_numpy(), members.offsets.to_numpy()[:-1] - members.offsets[0].as_py()
    values = batch.column("_sum").flatten().to_numpy().reshape(batch.num_rows, -1)
    weights = batch.column("_n").to_numpy()
    return groups.select(list(keys)), np.add.reduceat(weights[order], starts), np.add.reduceat(values[order], starts)


def _frames(keys: pa.Table, weights: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = max(1, NUMBERS_AT_ONCE // max(1, sums.shape[1]))
    for at in range(0, len(weights), step):
        part = sums[at:at + step]
        lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * sums.shape[1], part.ravel())
        held = keys.slice(at, step).combine_chunks().columns
        yield pa.RecordBatch.from_arrays(
            [*[c.chunk(0) for c in held], pa.array(weights[at:at + step]), lists], names=[*keys.column_names, "_n", "_sum"])


def _partial(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """One row per key of every batch."""
    for batch in batches:
        if batch.num_rows:
            yield from _frames(*_sums(batch, keys))


def _merged(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """One row per key of batches that are sorted by key: only the last key of a batch may go on in the next."""
    open_rows = None
    for batch in batches:
        if not batch.num_rows:
            continue
        found, weights, sums = _sums(batch, keys)
        if open_rows is not None:
            # NaN differs from itself, but not as text.
            if repr(open_rows[0].to_pylist()) == repr(found.slice(0, 1).to_pylist()):
                weights[0] += open_rows[1][0]
                sums[0] += open_rows[2][0]
            else:
                yield from _frames(*open_rows)
        yield from _frames(found.slice(0, len(weights) - 1), weights[:-1], sums[:-1])
        open_rows = found.slice(len(weights) - 1), weights[-1:], sums[-1:]
    if open_rows is not None:
        yield from _frames(*open_rows)


def mean_pooled(df: DataFrame, keys: Sequence[str], vector: str, mask: str, dim: int, name: str = "pooled") -> DataFrame:
    """``(keys, name)``: the mean of the vectors whose mask is set, one row per key.

    Vectors are summed as matrices, batch by batch, before the shuffle; what is
    left of a key meets in one task, which holds one sum at a time, so neither
    the number of rows of a key nor ``dim`` bounds it. A key without a set mask
    gets zeros. Missing vectors and masks take no part, missing components
    count as 0; a vector of another length than ``dim`` is an error.
    """
    keys = list(keys)
    weight = F.when(F.col(vector).isNotNull(), F.coalesce(F.col(mask).cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))
    wrong = F.raise_error(F.concat(F.lit(f"not {dim} components: "), F.size(vector).cast("string")))
    zeros = F.array_repeat(F.lit(0.0), dim)
    value = F.when(weight == 0, zeros).when(F.size(vector) != dim, wrong.cast("array<double>")).otherwise(
        F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)) * weight))
    rows = df.select(*keys, weight.alias("_n"), value.alias("_sum"))
    schema = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys],
                           T.StructField("_n", T.DoubleType()), T.StructField("_sum", T.ArrayType(T.DoubleType()))])
    parts = rows.mapInArrow(partial(_partial, keys=keys), schema)
    whole = parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(partial(_merged, keys=keys), schema)
    count = F.greatest(F.col("_n"), F.lit(1e-9))
    return whole.select(*keys, F.transform("_sum", lambda x: x / count).alias(name))
