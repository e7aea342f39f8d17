"""From arriving posts to the two cleaned batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posthaste import schemas
from posthaste.functions import clock
from posthaste.operators import dedupe, filters, ranks, splits
from posthaste.sources import ranges, tables


def collect(arrivals: DataFrame, existing: DataFrame, order: str | Sequence[str],
            rules: filters.CandidateRules = filters.CandidateRules()) -> DataFrame:
    """New candidates among the arrivals.

    The first copy of an id counts, even if it fails the rules and a later
    copy would pass; ids already stored are skipped.
    """
    fresh = dedupe.new_rows(existing, arrivals, order)
    return filters.candidates(fresh, rules)


def collect_into(table_dir: str, arrivals: DataFrame, order: str | Sequence[str],
                 rules: filters.CandidateRules = filters.CandidateRules(),
                 target: int | None = None) -> DataFrame:
    """Append the new candidates to a stored table and return the table.

    They are staged first: the look-up in the stored table runs once, reads only
    the files whose range of ids the arrivals meet, and an empty result leaves
    the table alone. ``ord`` numbers all stored rows in the
    order of collection: runs after each other, and rows of a run by ``order``.
    With a ``target`` the table stops growing at so many rows.
    """
    spark = arrivals.sparkSession
    begin = ranges.next_order(spark, table_dir, schemas.CANDIDATES, "tweet_id", "ord")
    existing = ranges.possible_rows(arrivals, table_dir, schemas.CANDIDATES, "tweet_id")
    columns = [order] if isinstance(order, str) else list(order)
    found = collect(arrivals, existing, order, rules).withColumn("collected_at", clock.collected_at())
    placed, scratch = ranks.with_position(found, columns, "_position")
    numbered = placed.withColumn("ord", F.col("_position") + F.lit(begin))
    if target is not None:
        numbered = numbered.filter(F.col("ord") < target)
    tables.append_new(numbered.select(*schemas.CANDIDATES.fieldNames()), table_dir)
    tables.remove(spark, scratch)
    return tables.read_or_empty(spark, table_dir, schemas.CANDIDATES)


def clean_and_split(candidates: DataFrame, cleaned_dir: str,
                    n: int = splits.BATCH_ROWS) -> tuple[DataFrame, DataFrame]:
    """Stripped, distinct texts: the first ``n`` to annotate, the rest to score."""
    tables.write_table(dedupe.clean(candidates), cleaned_dir)
    cleaned = tables.read_posts(candidates.sparkSession, cleaned_dir, schemas.CLEANED)
    return splits.split_at(cleaned, n)
