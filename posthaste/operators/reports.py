"""Counts and costs over posts and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posthaste.functions import clock, numeric, text


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def _missing(column: str = "ragebait") -> Column:
    return F.count_if(text.is_missing(F.col(column)))


def _tokens(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def token_totals(df: DataFrame) -> DataFrame:
    return df.agg(_tokens("input_tokens").alias("input_tokens"),
                  _tokens("output_tokens").alias("output_tokens"))


def missing_count(df: DataFrame, column: str = "ragebait") -> DataFrame:
    return df.agg(_missing(column).alias("n_missing"))


def chunk_report(df: DataFrame) -> DataFrame:
    """Posts, failures and failure rate of each chunk."""
    return (df.groupBy("chunk_id")
            .agg(F.count("*").alias("n_posts"), _missing().alias("n_failed"))
            .withColumn("failure_rate", numeric.ratio(F.col("n_failed"), F.col("n_posts"))))


def chunk_throughput(df: DataFrame) -> DataFrame:
    """Seconds each chunk took and posts per second, infinite for no time."""
    seconds = F.max("finished_at").cast("double") - F.min("started_at").cast("double")
    return (df.groupBy("chunk_id")
            .agg(F.count("*").alias("n_posts"), seconds.alias("elapsed"))
            .withColumn("posts_per_sec", numeric.ratio(F.col("n_posts"), F.col("elapsed"), float("inf"))))


def cost_report(df: DataFrame, price: float = numeric.DOLLARS_PER_BILLION_TOKENS) -> DataFrame:
    """Rows, missing rows, tokens and dollars of a whole run."""
    return (df.agg(F.count("*").alias("n_rows"), _missing().alias("n_missing"),
                   _tokens("input_tokens").alias("input_tokens"),
                   _tokens("output_tokens").alias("output_tokens"))
            .withColumn("cost", numeric.token_cost(F.col("input_tokens"), price)))


def yield_report(df: DataFrame, start, days: int | None = None) -> DataFrame:
    """Qualifying posts per query, and per search window when ``days`` is given."""
    keys = [F.col("query_source")]
    if days:
        keys.append(clock.window_index(F.col("created_ts"), clock.utc(start), days).alias("window"))
    return df.groupBy(*keys).agg(F.count("*").alias("posts"))
