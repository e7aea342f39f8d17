"""Duplicates, unions and joins of a new batch with what is stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posthaste.functions import text


def keep_first(df: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The row of each key that comes first by ``order``; NULL is one key.

    Spark limits each group to one row before the shuffle, so a key with many
    copies sends one row per task, not all of them, to its partition.
    """
    order = [order] if isinstance(order, str) else list(order)
    first = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_nth", F.row_number().over(first))
            .filter("_nth = 1").drop("_nth"))


def dedupe_text(df: DataFrame, order: str = "ord") -> DataFrame:
    """Strip the text, then keep the first row of each text."""
    return keep_first(df.withColumn("text", text.strip(F.col("text"))), ["text"], order)


def clean(df: DataFrame, order: str = "ord") -> DataFrame:
    """(ord, text): stripped texts, each once, with the order key of its first row.

    Only key and text are read, and copies collapse before the shuffle.
    """
    return (df.groupBy(text.strip(F.col("text")).alias("text"))
            .agg(F.min(order).alias("ord")).select("ord", "text"))


def exclude_seen(new: DataFrame, existing: DataFrame, key: str = "tweet_id",
                 arrivals: DataFrame | None = None) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet; NULL is one key, as in :func:`keep_first`.

    The stored keys that recur in ``new`` are looked up first. That result is
    no larger than ``new``, so Spark can broadcast the small batch to the big
    table instead of shuffling the big table's keys. ``arrivals`` may name a
    cheaper frame with the same keys.
    """
    wanted = (new if arrivals is None else arrivals).select(F.col(key).alias("_wanted")).distinct()
    recurring = (existing.select(F.col(key).alias("_seen"))
                 .join(wanted, F.col("_seen").eqNullSafe(F.col("_wanted")), "left_semi"))
    return new.join(recurring, F.col(key).eqNullSafe(F.col("_seen")), "left_anti")


def stack(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all frames; a column one of them lacks is NULL there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def merge_keep_existing(existing: DataFrame, new: DataFrame, order: str | Sequence[str],
                        key: str = "tweet_id") -> DataFrame:
    """Stored rows plus the first new row of every key that is not stored."""
    return stack(existing, new_rows(existing, new, order, key))


def new_rows(existing: DataFrame, new: DataFrame, order: str | Sequence[str],
             key: str = "tweet_id") -> DataFrame:
    """First rows of keys that are not stored. Duplicates go first, so that a
    key with many copies meets the join as one row."""
    return exclude_seen(keep_first(new, [key], order), existing, key, arrivals=new)


def attach(df: DataFrame, results: DataFrame, key: str = "ord") -> DataFrame:
    """Put the result columns next to the rows they belong to."""
    return df.join(results, key, "left")


def patch_results(base: DataFrame, redo: DataFrame, columns: Sequence[str],
                  key: str = "ord", marker: str = "ragebait") -> DataFrame:
    """Fill rows that have no ``marker`` from a second pass over them."""
    again = redo.select(key, *[F.col(c).alias(f"_redo_{c}") for c in columns])
    failed = text.is_missing(F.col(marker)).alias("_failed")
    patched = [F.when(F.col("_failed"), F.coalesce(F.col(f"_redo_{c}"), F.col(c)))
               .otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
               for c in base.columns]
    return (base.select("*", failed).join(again, key, "left").select(*patched))
