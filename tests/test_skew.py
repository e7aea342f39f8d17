"""One key, text or value holds a third of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from posthaste.operators import dedupe, splits, stats, training

N = 30_000


@pytest.fixture(scope="module")
def skewed(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(N).select(
        F.col("id").alias("ord"),
        F.when(hot, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("tweet_id"),
        F.when(hot, F.lit(" the same text ")).otherwise(F.concat(F.lit("text "), "id")).alias("text"),
        F.when(hot, F.lit(0.5)).otherwise((F.col("id") % 1000) / 1000.0).alias("score"),
        F.when(hot, F.lit(0.25)).otherwise((F.col("id") * 7 % 911) / 911.0).alias("p")).repartition(16)


def test_first_copy_of_a_hot_key(spark, skewed):
    kept = dedupe.keep_first(skewed, ["tweet_id"], "ord")
    assert kept.count() == N - N // 3 + 1
    assert kept.filter("tweet_id = 'hot'").first()["ord"] == 0


def test_clean_a_hot_text(skewed):
    found = dedupe.clean(skewed)
    assert found.count() == N - N // 3 + 1
    assert found.filter("text = 'the same text'").first()["ord"] == 0


def test_training_rows_with_a_hot_text(skewed):
    assert training.prepare_training(skewed.select("ord", "text", "score")).count() == N - N // 3 + 1


def test_merge_with_a_hot_key(skewed):
    existing = skewed.filter("ord % 2 = 1 and tweet_id <> 'hot'")
    found = dedupe.merge_keep_existing(existing, skewed, "ord")
    assert found.count() == found.select("tweet_id").distinct().count() == N - N // 3 + 1


def test_ranks_with_a_hot_value(skewed):
    pdf = skewed.select("score", "p").toPandas()
    expected = np.corrcoef(pdf["score"].rank(), pdf["p"].rank())[0, 1]
    for rows_per_range in (500, 1_000_000):
        assert stats.spearman(skewed, "score", "p", rows_per_range=rows_per_range).first()[0] == pytest.approx(expected)


def test_positions_with_a_gap_in_the_order(spark, skewed):
    # Two thirds of the order keys lie in a thousandth of their span.
    far = skewed.withColumn("ord", F.when(F.col("ord") < 20_000, F.col("ord")).otherwise(F.col("ord") * 1000))
    head, rest = splits.split_at(far, 19_999)
    assert (head.count(), rest.count()) == (19_999, N - 19_999)
    sizes = [r["count"] for r in splits.assign_chunks(far, 4000).groupBy("chunk_id").count().orderBy("chunk_id").collect()]
    assert sizes == [4000] * 7 + [2000]
