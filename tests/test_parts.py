"""Streams over more than one part of the events: the same rows, and never more than a part on disk."""

import time

import pytest
from pyspark.sql import functions as F

import compare
from posthaste import session
from posthaste.operators import filters
from posthaste.plans import queries
from posthaste.sources import tables
from posthaste.streaming import posts as streams


@pytest.mark.parametrize("name", ["stream_candidates", "stream_ingest_restarted", "stream_scores", "stream_dedupe",
                                  "stream_windows"])
def test_a_table_of_parts_lands_part_by_part(spark, sf, monkeypatch, name):
    monkeypatch.setattr(queries, "PART_EVENTS", 100, raising=False)
    monkeypatch.setattr(queries, "MAX_PARTS", 4, raising=False)
    landed = []
    landing_stream = queries.streams.landing_stream

    def seen(session, landing, *args, **named):
        landed.append((landing, session.read.parquet(landing).count()))
        return landing_stream(session, landing, *args, **named)

    monkeypatch.setattr(queries.streams, "landing_stream", seen)
    assert compare.mismatch(spark, compare.database(sf), sf, name) is None
    rows = [n for _, n in landed]
    events = tables.read_posts(spark, f"{sf}/events.parquet").count()
    assert sum(rows) == events * (10 if name == "stream_windows" else 11) // 10
    assert len(rows) >= 4 and max(rows) < 0.4 * sum(rows)
    # The second turn of the ingest is a single part, which stays.
    place = landed[0][0]
    left = spark.read.parquet(place).count() if tables.path_exists(spark, place) else 0
    assert left == (rows[-1] if name == "stream_ingest_restarted" else 0)


@pytest.mark.parametrize("ts", ["timestamp_seconds(1700000000 + cast(id / 7 as long))", "timestamp_seconds(1700000000)",
                                "cast(null as timestamp)", "if(id % 3 = 0, null, timestamp_seconds(id))"])
def test_parts_by_time_take_each_post_once_and_in_order(spark, monkeypatch, ts):
    monkeypatch.setattr(queries, "PART_EVENTS", 100)
    events = spark.range(2000).selectExpr("id as event_id", f"{ts} as ts")
    events = events.unionByName(events.filter("event_id % 10 = 0")).persist()
    posts = events.selectExpr("event_id as ord", "ts as created_ts")
    parts = queries._parts_by_time(events)
    assert len(parts) == queries.MAX_PARTS
    met = posts.select("*", *[p.cast("int").alias(f"p{i}") for i, p in enumerate(parts)]).persist()
    names = [f"p{i}" for i in range(len(parts))]
    assert met.filter(" + ".join(names) + " = 1").count() == 2200
    found = [met.filter(f"{n} = 1").agg(F.count("*"), F.min("created_ts"), F.max("created_ts")).first() for n in names]
    assert max(n for n, *_ in found) < 2 * 2200 / len(parts)
    timed = [(low, high) for _, low, high in found if low is not None]
    assert all(high <= low for (_, high), (low, _) in zip(timed, timed[1:]))


def test_parts_by_id_take_each_post_once_and_copies_together(spark, monkeypatch):
    monkeypatch.setattr(queries, "PART_EVENTS", 100)
    events = spark.range(2000).selectExpr("if(id % 50 = 0, null, cast(id / 2 as long)) as event_id")
    posts = events.selectExpr("event_id as ord")
    parts = queries._parts_by_id(events)
    sets = [{r["ord"] for r in posts.filter(p).collect()} for p in parts]
    assert sum(posts.filter(p).count() for p in parts) == 2000
    assert sum(map(len, sets)) == len(set().union(*sets))


def test_scores_are_written_without_a_second_copy_of_the_texts(spark, sf, monkeypatch):
    written = []
    to_parquet = streams.to_parquet
    monkeypatch.setattr(streams, "to_parquet", lambda df, *a: written.append(df) or to_parquet(df, *a))
    assert queries.QUERIES["stream_scores"](spark, sf).filter("as_in_batch").count() == 1000
    assert written and all("text" not in df.columns for df in written)


def test_a_rejected_post_uses_up_its_id_without_its_text(spark, folder):
    """With a least length of 0 a text that is left out must not pass."""
    schema = "tweet_id string, text string, created_at string, likes long, replies long, reposts long, arrival int"
    at, rules = "Wed Aug 12 14:23:01 +0000 2026", filters.CandidateRules(min_len=0, max_len=20, min_engagement=5)
    rows = [("a", "x" * 30, at, 9, 0, 0, 1), ("a", "short", at, 9, 0, 0, 2), ("b", "short", at, 9, 0, 0, 1),
            ("c", None, at, 9, 0, 0, 1), ("d", "short", at, 1, 0, 0, 1), ("e", "short", None, 9, 0, 0, 1)]
    landing, out, state = (f"{folder}/{n}" for n in ("landing", "out", "state"))
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(landing)
    stream = streams.landing_stream(spark, landing, spark.createDataFrame([], schema).schema)
    carried = []
    dedupe_stream = streams.dedupe_stream
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(streams, "dedupe_stream", lambda df, *a, **b: carried.append(df) or dedupe_stream(df, *a, **b))
        kept = streams.candidate_stream(stream, "10 days", rules, order=["arrival"])
        streams.to_parquet(kept, out, state).awaitTermination()
        streams.to_parquet(carried[0].select("tweet_id", "text"), f"{folder}/carried", f"{folder}/s").awaitTermination()
    assert sorted((r["tweet_id"], r["text"]) for r in spark.read.parquet(out).collect()) == [("b", "short"), ("c", "")]
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/carried").collect()]
    assert sorted(t for t in texts if t is not None) == ["short", "short"]


def test_files_of_finished_shuffles_go(spark, folder):
    def shuffles():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {f for f in found.split() if f.endswith(".data")}

    before = shuffles()
    spark.range(1000).repartition(8, "id").write.parquet(f"{folder}/rows")
    made = shuffles() - before
    assert made
    session.release_shuffles(spark)
    for _ in range(50):
        if not made & shuffles():
            return
        time.sleep(0.2)
    raise AssertionError("shuffle files stay")
