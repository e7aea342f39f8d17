"""Category and constant columns for regression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns that a plan still handles well; a caller may ask for more.
MAX_CATEGORIES = 2_000


def categories(df: DataFrame, column: str, most: int | None = None) -> list[str]:
    """Sorted distinct values. Each becomes a column, so more than ``most`` fail."""
    most = MAX_CATEGORIES if most is None else most
    found = df.select(F.col(column).cast("string").alias("c")).distinct().dropna().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"'{column}' has more than {most} categories")
    return sorted(r["c"] for r in found)


def dummies(df: DataFrame, columns: Sequence[str],
            domains: Mapping[str, Sequence[str]] | None = None, most: int | None = None) -> DataFrame:
    """Replace each column by 0/1 columns ``<column>_<category>``.

    The first category is the baseline and gets no column. A missing value is
    0 everywhere. ``domains`` fixes the categories instead of reading them.
    """
    added = []
    for column in columns:
        domain = sorted(domains[column]) if domains and column in domains else categories(df, column, most)
        added += [F.coalesce((F.col(column) == F.lit(c)).cast("int"), F.lit(0)).alias(f"{column}_{c}")
                  for c in domain[1:]]
    return df.select(*[c for c in df.columns if c not in columns], *added)


def add_const(df: DataFrame) -> DataFrame:
    return df.select(F.lit(1.0).alias("const"), "*")
