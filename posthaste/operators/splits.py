"""Splits, samples and chunks with exact sizes.

Each split looks up the order keys at its cut ranks and compares rows with
them. The rows themselves are neither sorted nor shuffled. Sizes are exact
whatever the keys: rows that share a key, NULL too, are told apart by a digest
of the whole row, and equal rows are divided by number.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posthaste.operators import ranks

BATCH_ROWS = 49_812   # rows that go to annotation; the rest is scored
CHUNK_ROWS = 2_000
TEST_SHARE = 0.05
FOLDS = 3
SEED = 42


def split_at(df: DataFrame, n: int = BATCH_ROWS, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows and the rest; NULL order keys come last."""
    return ranks.cut_at(df, ranks.by_column(order), n)


def holdout(df: DataFrame, test_size: float = TEST_SHARE, seed: int = SEED,
            key: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(train, test) by seeded order; the test part has ceil(n * test_size) rows."""
    rows = df.count()
    test, train = ranks.cut_at(df, ranks.seeded(seed, key), math.ceil(rows * test_size), rows)
    return train, test


def sample_n(df: DataFrame, n: int, seed: int = SEED, key: str = "ord") -> DataFrame:
    """``n`` rows drawn without replacement; all rows when there are fewer."""
    return ranks.cut_at(df, ranks.seeded(seed, key), n)[0]


def kfold(df: DataFrame, k: int = FOLDS, seed: int = SEED, key: str = "ord") -> DataFrame:
    """Add ``fold`` in 0..k-1; the first n mod k folds get one row more."""
    rows = df.count()
    base, extra = divmod(rows, k)
    if not base:
        raise ValueError(f"cannot make {k} folds of {extra} rows")
    starts = [i * base + min(i, extra) for i in range(1, k)]
    return ranks.with_part(df, ranks.seeded(seed, key), starts, "fold", rows)


def assign_chunks(df: DataFrame, size: int = CHUNK_ROWS, order: str = "ord") -> DataFrame:
    """Add ``chunk_id``: consecutive runs of ``size`` rows by position."""
    placed = ranks.with_ordinal(df, ranks.by_column(order), "_ordinal")
    return (placed.withColumn("chunk_id", F.floor(F.col("_ordinal") / F.lit(size)).cast("long"))
            .drop("_ordinal"))


def seeded_shuffle(df: DataFrame, seed: int = SEED, key: str = "ord") -> DataFrame:
    return df.orderBy(ranks.seeded(seed, key).column, ranks.row_digest(df))


def fold_pairs(df: DataFrame, k: int = FOLDS) -> DataFrame:
    """Each row once per fold round, as training or validation row of it."""
    rounds = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    return (df.withColumn("round", rounds)
            .withColumn("role", F.when(F.col("fold") == F.col("round"), "val").otherwise("train")))
