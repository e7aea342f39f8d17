"""Sources, annotation, training and streams, end to end."""

import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from posthaste import schemas
from posthaste.operators import annotate, filters, model, reports, splits, stats, training
from posthaste.plans import annotation, curate, train
from posthaste.session import work_dir
from posthaste.sources import history, ranges, samples, tables
from posthaste.streaming import posts as streams


# --- sources ---------------------------------------------------------------

def test_missing_table_is_empty(spark, folder):
    empty = tables.read_or_empty(spark, f"{folder}/none", schemas.CANDIDATES)
    assert empty.count() == 0 and empty.columns == schemas.CANDIDATES.fieldNames()


def test_csv_keeps_line_breaks_and_quotes(spark, folder):
    path = f"{folder}/t.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write('ord,text\n1,"a ""b"", c\nd"\n2,plain\n')
    rows = tables.read_table(spark, path, schemas.CLEANED).orderBy("ord").collect()
    assert [tuple(r) for r in rows] == [(1, 'a "b", c\nd'), (2, "plain")]


def test_uncommitted_version_is_not_read(spark, folder):
    place = f"{folder}/t"
    df = spark.createDataFrame([(1, "a")], schemas.CLEANED)
    assert tables.publish(df, place) == 1
    os.makedirs(f"{place}/version=2")  # a writer that died
    assert tables.read_published(spark, place, schemas.CLEANED).count() == 1
    assert tables.publish(tables.read_published(spark, place, schemas.CLEANED).filter("false"), place) == 3
    assert tables.read_published(spark, place, schemas.CLEANED).count() == 0


def test_writers_at_the_same_time_get_a_version_each(spark, folder):
    place = f"{folder}/t"
    frames = [spark.createDataFrame([(i, "a")], schemas.CLEANED) for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda df: tables.publish(df, place), frames))
    assert sorted(versions) == list(range(1, 7))
    for i, version in enumerate(versions):
        assert [r["ord"] for r in spark.read.parquet(f"{place}/version={version}").collect()] == [i]
    assert [r["ord"] for r in tables.read_published(spark, place, schemas.CLEANED).collect()] == [versions.index(6)]


def test_a_stale_frame_replaces_nothing(spark, folder):
    place = f"{folder}/t"
    df = spark.createDataFrame([(1, "a")], schemas.CLEANED)
    assert tables.publish(df, place, after=0) == 1
    with pytest.raises(tables.Conflict):
        tables.publish(df, place, after=0)
    open(f"{place}/claims/2", "w").close()  # a writer that has begun
    with pytest.raises(tables.Conflict):
        tables.publish(df, place, after=1)
    assert tables.publish(df, place) == 3


def test_work_dir_takes_the_setting_of_the_session(spark):
    assert work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


# --- annotation ----------------------------------------------------------------

def chunked(spark, folder, n=50, size=10):
    rows = spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("text "), "id").alias("text"))
    tables.write_table(splits.assign_chunks(rows, size), f"{folder}/chunked")
    return spark.read.parquet(f"{folder}/chunked")


def test_failed_rows_are_missing_and_patched_later(spark, folder):
    def failing_scorer(content):
        if int(content.split()[1]) % 7 == 0:
            raise annotate.ScoringError(content)
        return annotate.offline_scorer(content)

    out = annotate.annotate_chunks(chunked(spark, folder), f"{folder}/out", failing_scorer)
    assert out.count() == 50
    assert reports.missing_count(out).first()[0] == 8
    # A done chunk is not tried again.
    again = annotate.annotate_chunks(spark.read.parquet(f"{folder}/chunked"), f"{folder}/out", annotate.offline_scorer)
    assert reports.missing_count(again).first()[0] == 8
    fixed = annotate.retry_missing(out, annotate.offline_scorer, f"{folder}/redo")
    assert reports.missing_count(fixed).first()[0] == 0
    assert fixed.count() == 50


def test_one_more_try_within_the_run(spark, folder):
    marks = f"{folder}/marks"
    os.makedirs(marks)

    def flaky(content):
        mark = f"{marks}/{content}"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise annotate.ScoringError(content)
        return annotate.offline_scorer(content)

    out = annotate.annotate_chunks(chunked(spark, folder), f"{folder}/out", flaky)
    assert reports.missing_count(out).first()[0] == 0


def test_stopped_job_goes_on_with_open_chunks(spark, folder):
    rows = chunked(spark, folder)

    def stops(content):
        if int(content.split()[1]) >= 30:
            raise RuntimeError("stopped")
        return annotate.offline_scorer(content)

    with pytest.raises(Exception, match="stopped"):
        annotate.annotate_chunks(rows, f"{folder}/out", stops, chunks_per_run=1)
    assert {r["chunk_id"] for r in annotate.done_chunks(spark, f"{folder}/out").collect()} == {0, 1, 2}
    calls = f"{folder}/calls"
    os.makedirs(calls)

    def counted(content):
        open(f"{calls}/{content}", "w").close()
        return annotate.offline_scorer(content)

    done = annotate.annotate_chunks(rows, f"{folder}/out", counted, chunks_per_run=1)
    assert done.count() == done.select("ord").distinct().count() == 50
    assert len(os.listdir(calls)) == 20
    report = reports.chunk_throughput(done).collect()
    assert len(report) == 5 and all(r["elapsed"] >= 0 for r in report)


def test_other_errors_of_a_scorer_are_not_hidden(spark):
    rows = spark.createDataFrame([(1, "x")], schemas.CLEANED)

    def broken(content):
        raise KeyError("bug")

    with pytest.raises(Exception, match="bug"):
        annotate.annotate(rows, broken).collect()


# --- training ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def scored_texts(spark):
    words = ["calm", "quiet", "plain", "angry", "furious", "outrage"]
    rows = spark.range(240).select(
        F.col("id").alias("ord"), *[F.lit(w).alias(w) for w in words]).select(
        "ord",
        F.concat_ws(" ", *[F.when((F.col("ord") * p) % 7 < 3, F.col(w)) for w, p in zip(words, (1, 2, 3, 4, 5, 6))],
                    F.col("ord").cast("string")).alias("text"))
    score = sum((F.contains("text", F.lit(w)).cast("double") * v
                 for w, v in zip(words, (-0.1, -0.05, -0.05, 0.2, 0.2, 0.2))), F.lit(0.3))
    return tables.stored(rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))), "texts")


def test_model_beats_the_mean_and_survives_a_reload(spark, scored_texts, folder):
    train_rows, test_rows = splits.holdout(scored_texts, 0.25)
    fitted = model.fit_regressor(train_rows, {"num_features": 512})
    mean = train_rows.agg(F.avg("score")).first()[0]
    predicted = model.score_posts(test_rows, fitted)
    ours = stats.evaluate(predicted, "score", model.PREDICTION).first()
    base = stats.regression_metrics(test_rows.withColumn("p", F.lit(mean)), "score", "p").first()
    assert ours["mae"] < 0.6 * base["mae"] and ours["spearman"] > 0.7
    assert predicted.filter(~F.col(model.PREDICTION).between(0, 1)).count() == 0
    history.save_model(fitted, f"{folder}/m")
    again = model.score_posts(test_rows, history.load_model(f"{folder}/m"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, predicted.collect()))


def test_scoring_is_narrow(spark, scored_texts):
    fitted = model.fit_regressor(scored_texts, {"num_features": 64, "max_iter": 2})
    text = model.score_posts(scored_texts, fitted)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text


def test_training_run(spark, scored_texts, folder, monkeypatch):
    seen = []
    monkeypatch.setattr(train.model, "search", lambda df, *a, f=model.search: seen.append(df) or f(df, *a))
    result = train.train(scored_texts, folder, {"reg_param": model.Between(1e-4, 1e-2, True), "max_iter": model.OneOf((5,))},
                         n_trials=2, test_size=0.1, hpo_subsample_size=100)
    run = history.load_metadata(spark, f"{folder}/runs").first()
    assert (run["n_train_val"], run["n_test"], run["n_hpo_rows"], run["seed"]) == (216, 24, 100, 42)
    assert run["best_params"] == result["best_params"]
    assert set(result["cv_metrics"]) == {f"{m}_{s}" for m in stats.METRICS for s in ("mean", "std")}
    test_part = splits.holdout(training.prepare_training(scored_texts), 0.1)[1]
    assert seen[0].join(test_part, "ord").count() == 0
    found = train.infer(scored_texts, f"{folder}/model", f"{folder}/scored", 0.4)
    assert 0 < found.count() < 240 and found.agg(F.min(model.PREDICTION)).first()[0] >= 0.4


def test_random_search_table():
    space = {"size": model.Between(1, 10_000, by_magnitude=True), "share": model.Between(-1, 1),
             "kind": model.OneOf(("a", "b"))}
    drawn = model.sample_params(space, 300, 1)
    assert drawn == model.sample_params(space, 300, 1) != model.sample_params(space, 300, 2)
    assert all(1 <= d["size"] <= 10_000 and -1 <= d["share"] <= 1 for d in drawn)
    assert {d["kind"] for d in drawn} == {"a", "b"}
    assert 110 < sum(d["size"] < 100 for d in drawn) < 190  # half lies below the geometric middle


def test_plugin_predictor_gets_bounded_batches(spark):
    rows = spark.range(1000).select(F.col("id").alias("ord"), F.lit("x").alias("text")).coalesce(1)
    found = model.score_with(rows, lambda: lambda texts: [len(texts)] * len(texts), batch=256)
    assert found.agg(F.max(model.PREDICTION)).first()[0] == 256


# --- streams -------------------------------------------------------------------------

RULES = filters.CandidateRules(50, 5000, "2024-01-01", "2024-02-01", 50)
LANDED = ["tweet_id", "text", "created_at", "likes", "replies", "reposts", "query_source", "ord", "arrival"]


def run(query):
    query.awaitTermination()
    return query


def test_exact_ingest_equals_one_batch_and_survives_restarts(spark, sf, folder):
    arrived = samples.arrivals(spark, sf).select(*LANDED)
    landing, out, state = (f"{folder}/{n}" for n in ("landing", "out", "state"))
    for part in range(3):
        arrived.filter(F.col("ord") % 3 == part).write.mode("append").parquet(landing)
        stream = streams.landing_stream(spark, landing, arrived.schema)
        run(streams.ingest_exact(stream, out, state, ["arrival", "ord"], RULES))
    streamed = spark.read.parquet(out)
    batch = curate.collect(arrived, arrived.filter("false"), ["arrival", "ord"], RULES)
    ids = lambda df: sorted(r["tweet_id"] for r in df.select("tweet_id").collect())
    assert ids(streamed) == ids(batch)
    # A lost checkpoint replays everything and adds nothing.
    stream = streams.landing_stream(spark, landing, arrived.schema)
    run(streams.ingest_exact(stream, out, f"{folder}/state2", ["arrival", "ord"], RULES))
    assert ids(spark.read.parquet(out)) == ids(batch)


def test_stream_filter_comes_after_dedupe(spark, folder):
    schema = "tweet_id string, text string, created_at string, likes long, replies long, reposts long"
    rows = [("a", "x" * 60, "Mon Jan 01 00:00:00 +0000 2024", 40, 0, 0),
            ("a", "x" * 60, "Mon Jan 01 00:00:00 +0000 2024", 60, 0, 0),
            ("b", "x" * 60, "Mon Jan 01 00:00:00 +0000 2024", 60, 0, 0)]
    landing, out, state = (f"{folder}/{n}" for n in ("landing", "out", "state"))
    for row in rows:  # one file and one micro-batch each
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(landing)
        stream = streams.landing_stream(spark, landing, spark.createDataFrame([], schema).schema)
        kept = streams.candidate_stream(stream, "10 days", RULES)
        run(streams.to_parquet(kept, out, state))
    assert [r["tweet_id"] for r in spark.read.parquet(out).collect()] == ["b"]


def test_stream_keeps_the_first_copy_of_a_batch(spark, folder):
    schema = "tweet_id string, text string, created_at string, likes long, replies long, reposts long, arrival int"
    day = "Mon Jan 01 00:00:00 +0000 2024"
    rows = [("a", "x" * 60, day, 60, 0, 0, 2), ("a", "x" * 60, day, 40, 0, 0, 1), ("b", "x" * 60, day, 60, 0, 0, 1),
            (None, "x" * 60, day, 70, 0, 0, 1), (None, "x" * 60, day, 60, 0, 0, 2), ("c", "x" * 60, None, 60, 0, 0, 1)]
    landing, out, state = (f"{folder}/{n}" for n in ("landing", "out", "state"))
    for turn in range(2):  # the second file only repeats the ids of the first
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = streams.landing_stream(spark, landing, spark.createDataFrame([], schema).schema)
        kept = streams.candidate_stream(stream, "10 days", RULES, order=["arrival"])
        run(streams.to_parquet(kept, out, state))
    found = {(r["tweet_id"], r["likes"]) for r in spark.read.parquet(out).collect()}
    assert found == {("b", 60), (None, 70)}


def test_first_copies_of_a_task_in_batches_of_any_size(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [{"k": None if k == 3 else f"k{k}", "a": None if a == 4 else int(a), "v": v}
            for v, (k, a) in enumerate(rng.integers(0, 9, (500, 2)))]
    last = {}
    for row in rows:
        order = (row["a"] is None, row["a"] or 0)
        if row["k"] not in last or order < last[row["k"]]:
            last[row["k"]] = order
    for held in (1, 7, 100_000):
        monkeypatch.setattr(streams, "HELD_ROWS", held)
        batches = [pa.RecordBatch.from_pylist(rows[i:i + 13]) for i in range(0, 500, 13)]
        found = [r for b in streams._first_copies(iter(batches), "k", ["a"]) for r in b.to_pylist()]
        assert {r["k"]: (r["a"] is None, r["a"] or 0) for r in found} == last and len(found) == len(last)
    assert list(streams._first_copies(iter([]), "k", ["a"])) == []


def test_stream_dedupe_calls_no_python_per_id(spark, sf, folder):
    samples.arrivals(spark, sf).select(*LANDED).write.parquet(f"{folder}/landing")
    stream = streams.landing_stream(spark, f"{folder}/landing", spark.read.parquet(f"{folder}/landing").schema)
    timed = stream.withColumn("created_ts", F.col("created_at").cast("timestamp"))
    unique = streams.dedupe_stream(timed, "10 days", order=["arrival", "ord"])
    text = unique._jdf.queryExecution().analyzed().toString()
    assert "DeduplicateWithinWatermark" in text and "FlatMapGroups" not in text


def test_commits_do_not_grow_with_chunks(spark, folder, monkeypatch):
    monkeypatch.setattr(annotate, "MAX_RUNS", 3)
    rows = spark.range(120).selectExpr("id as ord", "concat('text ', id) as text")
    result = annotation.run(rows, folder, annotate.offline_scorer, size=4, chunks_per_run=2)
    assert len(tables.committed_runs(spark, f"{folder}/answers")) == 3
    assert result["report"].first().asDict()["chunks"] == 30
    again = annotation.run(rows, folder, annotate.offline_scorer, size=4, chunks_per_run=2)
    assert len(tables.committed_runs(spark, f"{folder}/answers")) == 3
    assert again["annotated"].count() == 120


def test_collecting_numbers_rows_and_leaves_no_staging(spark, sf, folder):
    base = spark.conf.get("spark.checkpoint.dir")
    arrived = samples.arrivals(spark, sf).withColumn("tweet_id", F.when(F.col("ord") % 5 > 0, F.col("tweet_id")))
    before = {n for n in os.listdir(base) if n.startswith(("ranges", "accepted"))}
    for target in (20, 50, None, None):
        kept = curate.collect_into(f"{folder}/t", arrived, ["arrival", "ord"], RULES, target)
        assert target is None or kept.count() == target
    rows = kept.collect()
    assert sorted(r["ord"] for r in rows) == list(range(len(rows)))
    assert all(r["created_ts"] is not None for r in rows) and sum(r["tweet_id"] is None for r in rows) <= 1
    assert {n for n in os.listdir(base) if n.startswith(("ranges", "accepted"))} == before


def test_json_landing(spark, sf, folder):
    rows = samples.posts(spark, sf).withColumn("arrival", F.lit(1)).select(*LANDED)
    rows.write.json(f"{folder}/landing")
    stream = streams.landing_stream(spark, f"{folder}/landing", rows.schema, "json")
    run(streams.to_parquet(stream.select("ord"), f"{folder}/out", f"{folder}/state"))
    assert spark.read.parquet(f"{folder}/out").count() == rows.count()


def test_whole_path_from_arrivals_to_scores(spark, sf, folder):
    arrived = samples.arrivals(spark, sf).select(*LANDED)
    kept = curate.collect_into(f"{folder}/candidates", arrived, ["arrival", "ord"], RULES)
    head, rest = curate.clean_and_split(kept, f"{folder}/cleaned", n=100)
    assert head.count() == 100 and head.agg(F.max("ord")).first()[0] < rest.agg(F.min("ord")).first()[0]
    tables.write_table(splits.assign_chunks(head, 30), f"{folder}/chunks")
    done = annotate.annotate_chunks(spark.read.parquet(f"{folder}/chunks"), f"{folder}/answers", annotate.offline_scorer)
    scored = done.select("ord", "text", F.col("ragebait").alias("score"))
    train.train(scored, f"{folder}/trained", {"reg_param": model.Between(1e-3, 1e-2, True), "max_iter": model.OneOf((3,))}, n_trials=1)
    final = train.infer(rest, f"{folder}/trained/model", f"{folder}/scored")
    assert final.count() == rest.count()


def test_look_ups_read_only_files_that_can_hold_an_id(spark, folder):
    def day(n):
        return spark.range(100).selectExpr(
            f"cast({n} * 1000 + 1000000 + id as string) as tweet_id", "repeat('x', 60) as text",
            "'Mon Jan 01 00:00:00 +0000 2024' as created_at", "60L as likes", "0L as replies", "0L as reposts",
            "'q' as query_source", "id as ord")
    place, seen = f"{folder}/t", []
    for n in range(6):
        seen.append(len(ranges.possible_files(day(n), place, "tweet_id")))
        kept = curate.collect_into(place, day(n), "ord", RULES)
        assert kept.count() == 100 * (n + 1)
    # Files looked into do not grow with the table: only those without a row yet.
    assert max(seen[2:]) <= max(seen[:2]) and len(ranges._files(spark, place)) >= 6
    # A batch of old and new ids reads the old ones' files, and nothing comes in twice.
    mixed = day(2).unionByName(day(9).limit(7)).unionByName(day(2).limit(1).withColumn("tweet_id", F.lit(None).cast("string")))
    assert len(ranges.possible_files(mixed, place, "tweet_id")) < len(ranges._files(spark, place))
    assert curate.collect_into(place, mixed, "ord", RULES).count() == 608
    assert curate.collect_into(place, mixed, "ord", RULES).count() == 608
    # A lost or late range row only costs reads.
    tables.remove(spark, ranges.index_path(place))
    rows = curate.collect_into(place, day(4), "ord", RULES).collect()
    assert len(rows) == 608 and sorted(r["ord"] for r in rows) == list(range(608))
