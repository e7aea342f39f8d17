"""Projections, row filters and assertions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posthaste.functions import clock, numeric, text
from posthaste.operators import ranks


@dataclass(frozen=True)
class CandidateRules:
    """What a post must meet to be kept. Lengths are inclusive, dates half-open."""

    min_len: int = 50
    max_len: int = 280
    start: dt.date | str = "2026-01-01"
    end: dt.date | str = "2026-09-01"
    min_engagement: int = 50


def select_text(df: DataFrame) -> DataFrame:
    return df.select("ord", "text")


def drop_cols(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def length_ok(column: Column, low: int, high: int) -> Column:
    return F.length(text.strip(text.text_or_empty(column))).between(low, high)


def length_between(df: DataFrame, low: int = 50, high: int = 280, column: str = "text") -> DataFrame:
    """Keep stripped texts of ``low`` to ``high`` code points; NULL counts as ''."""
    return df.filter(length_ok(F.col(column), low, high))


def window_ok(ts: Column, start, end) -> Column:
    """NULL for a missing time, so that the plain comparison reaches the scan."""
    return (ts >= clock.utc(start)) & (ts < clock.utc(end))


def in_window(df: DataFrame, start, end, column: str = "created_ts") -> DataFrame:
    return df.filter(window_ok(F.col(column), start, end))


def total_engagement() -> Column:
    return numeric.engagement(F.col("likes"), F.col("replies"), F.col("reposts"))


def min_engagement(df: DataFrame, least: int = 50) -> DataFrame:
    return df.filter(total_engagement() >= least)


def passes(rules: CandidateRules = CandidateRules()) -> Column:
    """Whether a post with a parsed ``created_ts`` passes all three tests; never NULL."""
    return F.coalesce(length_ok(F.col("text"), rules.min_len, rules.max_len)
                      & window_ok(F.col("created_ts"), rules.start, rules.end)
                      & (total_engagement() >= rules.min_engagement), F.lit(False))


def candidates(df: DataFrame, rules: CandidateRules = CandidateRules()) -> DataFrame:
    """Posts that pass all three tests, with stripped text and typed time.

    Apply it after deduplication by id: a rejected copy still uses up its id.
    Works on a batch and on a stream. Further input columns are kept.
    """
    extra = [c for c in df.columns if c not in
             ("tweet_id", "text", "created_at", "likes", "replies", "reposts", "created_ts")]
    counters = ("likes", "replies", "reposts")
    return (_derived(df, *extra, "tweet_id", "created_at", *counters)
            .filter(F.col("_text_len").between(rules.min_len, rules.max_len))
            .filter(window_ok(F.col("created_ts"), rules.start, rules.end))
            .filter(total_engagement() >= rules.min_engagement)
            .select(text.as_text(F.col("tweet_id")).alias("tweet_id"), "text", "created_at", "created_ts",
                    *[numeric.or_zero(F.col(c)).alias(c) for c in counters],
                    total_engagement().alias("engagement_total"), *extra))


def _derived(df: DataFrame, *kept: str) -> DataFrame:
    """Stripped text, its length and the parsed time, worked out once per row.

    As the output of a generator they are values to the optimizer. Plain
    columns would be copied into each test that names them.
    """
    stripped = text.strip(text.text_or_empty(F.col("text")))
    once = F.inline(F.array(F.struct(stripped.alias("text"),
                                     clock.parse_created_at(F.col("created_at")).alias("created_ts"))))
    return df.select(*kept, once).withColumn("_text_len", F.length("text"))


def candidate_funnel(df: DataFrame, rules: CandidateRules = CandidateRules()) -> DataFrame:
    """Posts per first failing test, in the order length, date, engagement, or 'kept'."""
    reason = (F.when(~F.col("_text_len").between(rules.min_len, rules.max_len), "length")
              .when(~F.coalesce(window_ok(F.col("created_ts"), rules.start, rules.end), F.lit(False)), "date")
              .when(total_engagement() < rules.min_engagement, "engagement")
              .otherwise("kept"))
    return (_derived(df, "likes", "replies", "reposts")
            .groupBy(reason.alias("reason")).agg(F.count("*").alias("posts")))


def nonempty(df: DataFrame, column: str = "text") -> DataFrame:
    return df.filter(F.length(text.strip(F.col(column))) > 0)


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    absent = sorted(set(names) - set(df.columns))
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    return df


def score_check(df: DataFrame, column: str, *more: Column, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """One row: rows in all, rows without a number, rows out of range, ``more``."""
    value = F.col(column)
    missing = text.is_missing(value)
    return df.agg(F.count("*").alias("n_rows"),
                  F.count_if(missing).alias("n_missing"),
                  F.count_if(~missing & ~value.between(low, high)).alias("n_out_of_range"), *more)


def assert_range(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Fail when any number lies outside [low, high]; missing values are not counted."""
    bad = score_check(df, column, low=low, high=high).first()["n_out_of_range"]
    if bad:
        raise ValueError(f"{bad} rows have '{column}' outside [{low:g}, {high:g}]")
    return df


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~text.is_missing(F.col(column)))


def filter_scored(df: DataFrame, min_score: float, column: str = "inferred_ragebait") -> DataFrame:
    return df.filter(F.col(column) >= min_score)


def take_until(df: DataFrame, target: int, existing: int = 0, order: str = "ord") -> DataFrame:
    """The first rows by ``order`` that bring a table of ``existing`` rows to ``target``."""
    return ranks.cut_at(df, ranks.by_column(order), max(0, target - existing))[0]
