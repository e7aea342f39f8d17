"""What a job reads or repeats does not grow faster than its input."""

import pytest
from pyspark.sql import functions as F

import compare
from posthaste.operators import model, ranks, splits
from posthaste.plans import queries


def test_tied_rows_are_joined_once(spark, sf, monkeypatch):
    seen = []
    kfold = splits.kfold
    monkeypatch.setattr(queries.splits, "kfold", lambda df, **named: seen.append(df) or kfold(df, **named))
    queries.QUERIES["kfold_ties"](spark, sf)
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("hot", [7, None])
def test_cuts_inside_one_key_are_looked_up_together(spark, monkeypatch, hot):
    monkeypatch.setattr(ranks, "MAX_SORTED_KEYS", 40)
    rows = spark.range(900).select(F.when(F.col("id") % 9 == 0, F.col("id")).otherwise(F.lit(hot)).alias("k"),
                                   (F.col("id") % 2).alias("half"))
    calls = {"_keys_at": 0, "_range_sizes": 0}

    def counted(name):
        f = getattr(ranks, name)

        def call(*args):
            calls[name] += 1
            return f(*args)
        monkeypatch.setattr(ranks, name, call)

    counted("_keys_at")
    counted("_range_sizes")
    folds = splits.kfold(rows, 9, key="k")
    assert calls["_keys_at"] == 2 and calls["_range_sizes"] <= 4
    assert [r["count"] for r in folds.groupBy("fold").count().orderBy("fold").collect()] == [100] * 9
    order = lambda df: sorted(map(tuple, df.select("k", "half").collect()), key=str)
    assert order(folds) == order(rows)


@pytest.mark.parametrize("name", ["stream_windows", "stream_dedupe", "stream_candidates", "stream_ingest_restarted"])
def test_landing_files_grow_in_number_not_in_size(spark, sf, monkeypatch, name):
    monkeypatch.setattr(queries, "LANDED_ROWS", 100, raising=False)
    monkeypatch.setattr(queries, "LANDED_PER_TRIGGER", 4, raising=False)
    landed, per_trigger = [], []
    landing_stream = queries.streams.landing_stream

    def seen(session, landing, *args, **named):
        landed.append(landing)
        per_trigger.append(named["files_per_trigger"])
        return landing_stream(session, landing, *args, **named)

    monkeypatch.setattr(queries.streams, "landing_stream", seen)
    assert compare.mismatch(spark, compare.database(sf), sf, name) is None
    sizes = [r["count"] for r in spark.read.parquet(landed[0]).groupBy("_metadata.file_path").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 200
    assert max(per_trigger) <= 4 or name == "stream_windows"


def test_a_fit_makes_words_once(spark, folder):
    rows = spark.range(60).selectExpr("id as ord", "concat('some words ', id % 7) as text", "(id % 10) / 9.0 as score")
    calls = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    seen = rows.mapInArrow(read, rows.schema)
    model.fit_regressor(seen, {"max_iter": 3})
    assert calls.value == 60
    folded = splits.kfold(rows)
    kept = folded.mapInArrow(read, folded.schema)
    space = {"num_features": model.OneOf((16, 64)), "min_doc_freq": model.OneOf((1, 2)), "max_iter": model.OneOf((2,))}
    found = model.search(kept, space, n_trials=3).collect()
    assert calls.value == 120 and len(found) == 9


def test_counts_of_a_search_are_those_of_a_fit(spark):
    rows = splits.kfold(spark.range(60).selectExpr(
        "id as ord", "concat('some words ', id % 7, ' ', id % 11) as text", "(id % 10) / 9.0 as score"))
    params = {"num_features": 64, "min_doc_freq": 2, "reg_param": 1e-2, "max_iter": 5}
    counts = model._stored_counts(rows, [16, 64])
    assert sorted(counts) == [16, 64]
    for fold in range(2):
        fitted = model.fit_regressor(rows.filter(F.col("fold") != fold), params)
        expected = model.score_posts(rows.filter(F.col("fold") == fold), fitted)
        found = model._validated(counts[64], fold, params)
        near = [sorted(r[0] for r in df.select(model.PREDICTION).collect()) for df in (expected, found)]
        assert near[0] == pytest.approx(near[1], abs=1e-9)
