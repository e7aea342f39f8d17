"""Post-shaped tables from the general test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posthaste.functions import clock
from posthaste.operators.annotate import OFFLINE_FACTORS
from posthaste.operators.rubric import QUESTIONS
from posthaste.sources.tables import read_posts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_posts(spark, f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per document, with time and counters of an event."""
    documents = table(spark, sf_dir, "documents").withColumnRenamed("source", "query_source")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"),
        clock.format_created_at(F.col("ts")).alias("created_at"),
        F.col("ts").alias("created_ts"),
        F.floor("value").cast("long").alias("likes"),
        F.get_json_object("props", "$.k").cast("long").alias("replies"),
        (F.col("user_id") % 50).alias("reposts"))
    return documents.join(events, "doc_id").select(
        F.col("doc_id").cast("string").alias("tweet_id"), F.col("doc_id").alias("ord"), "text", "lang",
        "query_source", "created_at", "created_ts", "likes", "replies", "reposts")


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per event; the documents take turns as texts."""
    documents = table(spark, sf_dir, "documents").withColumnRenamed("source", "query_source")
    texts = documents.count()
    events = table(spark, sf_dir, "events")
    return (events.withColumn("doc_id", F.col("event_id") % texts).join(documents, "doc_id").select(
        F.col("event_id").cast("string").alias("tweet_id"), F.col("event_id").alias("ord"), "text", "lang",
        "query_source", clock.format_created_at(F.col("ts")).alias("created_at"), F.col("ts").alias("created_ts"),
        F.floor("value").cast("long").alias("likes"), F.get_json_object("props", "$.k").cast("long").alias("replies"),
        (F.col("user_id") % 50).alias("reposts")))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts, and a later copy with more likes of every tenth."""
    first = posts(spark, sf_dir).withColumn("arrival", F.lit(1))
    again = (first.filter("ord % 10 = 0").withColumn("arrival", F.lit(2))
             .withColumn("likes", F.col("likes") + 100))
    return first.unionByName(again)


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with answers by arithmetic on their length; every 37th failed."""
    n = F.length("text").cast("long")

    def answer(question: str, factor: int):
        kind = QUESTIONS[question]["type"]
        if kind == "noul":
            return (n * factor) % 101 / F.lit(100.0)
        if kind == "score":
            return ((n * factor) % 5).cast("double")
        options = F.lit(list(QUESTIONS[question]["criteria"]))
        return F.get(options, ((n * factor) % 7).cast("int"))

    ok = F.col("doc_id") % 37 != 0
    columns = {"input_tokens": n, "output_tokens": F.lit(12).cast("long"),
               **{q: answer(q, p) for q, p in zip(QUESTIONS, OFFLINE_FACTORS)}}
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), "text", *[F.when(ok, c).alias(name) for name, c in columns.items()])


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score in [0, 1]."""
    labels = table(spark, sf_dir, "labels")
    score = (0.8 * F.col("toxic") + 0.1 * (1 - F.col("quality"))
             + (F.length("text") % 11) / F.lit(110.0))
    return (table(spark, sf_dir, "documents").join(labels, "doc_id")
            .select(F.col("doc_id").alias("ord"), "text", score.alias("score")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training(spark, sf_dir).withColumn("p", F.least(F.lit(1.0), F.col("score") * 0.9 + 0.02))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, rater, label): two people and a model."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(F.col("doc_id").alias("item"), F.inline(F.array(*[
        F.struct(F.lit(r).alias("rater"), c.cast("int").alias("label"))
        for r, c in (("h1", F.col("toxic")), ("h2", F.col("quality")), ("m", F.length("text") % 2))])))
