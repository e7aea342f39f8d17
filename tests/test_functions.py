import datetime as dt
import math
import warnings

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from posthaste.functions import clock, numeric, tails, text
from posthaste.operators import pooling

SPACES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680, 0x2000,
          0x2009, 0x2028, 0x202F, 0x205F, 0x3000]
NOT_SPACES = [0x200B, 0xFEFF]


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_strip_drops_each_space_and_keeps_others(spark):
    padded = [chr(c) * 2 + "a b" + chr(c) for c in SPACES + NOT_SPACES]
    assert column(spark, padded + [None, "", " \n "], text.strip) == [s.strip() for s in padded] + [None, "", ""]


def test_strip_covers_every_code_point_python_strips(spark):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    assert sorted(spaces) == sorted(text.WHITESPACE)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from(list(text.WHITESPACE) + list("abé😀​.")), max_size=12),
                min_size=30, max_size=60))
def test_strip_equals_python(spark, values):
    assert column(spark, values, text.strip) == [v.strip() for v in values]


def test_length_counts_code_points(spark):
    values = ["a" * 49, "😀" * 50, "é" * 280, "x" * 281]
    assert column(spark, values, F.length) == [49, 50, 280, 281]


def python_parse(value):
    try:
        return dt.datetime.strptime(value, "%a %b %d %H:%M:%S %z %Y")
    except (ValueError, TypeError):
        return None


@pytest.mark.parametrize("value", [
    "Wed Aug 12 14:23:01 +0000 2026", "Wed Aug 2 14:23:01 +0000 2026", "Wed Aug 02 14:23:01 +0530 2026",
    "Mon Aug 12 14:23:01 +0000 2026", "Xxx Aug 12 14:23:01 +0000 2026", "garbage", "", None,
    "wed aug 12 14:23:01 +0000 2026", "WED AUG 12 14:23:01 -0800 2026", "Wed  Aug  12 14:23:01 +0000 2026",
    "Wed Aug 12 4:23:01 +0000 2026", "Wed Aug 12 14:23:01 +05:30 2026", "Wed Aug 32 14:23:01 +0000 2026",
    "Wed Feb 29 14:23:01 +0000 2026", "Wed Aug 12 24:23:01 +0000 2026", "Wed Aug 12 14:23:61 +0000 2026",
    "Aug 12 14:23:01 +0000 2026", "Wed Aug 12 14:23:01 2026", "Wed Aug 12 14:23:01 +0000 2026 x"])
def test_parse_created_at_equals_strptime(spark, value):
    [seconds] = column(spark, [value], lambda c: F.unix_seconds(clock.parse_created_at(c)))
    expected = python_parse(value)
    assert seconds == (None if expected is None else int(expected.timestamp()))


def test_created_at_round_trip(spark):
    values = ["Wed Aug 12 14:23:01 +0000 2026", "Thu Jan 01 00:00:00 +0000 2026"]
    assert column(spark, values, lambda c: clock.format_created_at(clock.parse_created_at(c))) == values


def test_windows_cover_the_whole_range(spark):
    start, end = clock.utc("2026-01-01"), clock.utc("2026-09-01")
    days = spark.range(243).select(F.date_add(F.lit("2026-01-01"), F.col("id").cast("int")).cast("timestamp").alias("ts"))
    index = clock.window_index(F.col("ts"), start)
    first, last = clock.window_bounds(F.col("i"), start, end)
    rows = days.select("ts", index.alias("i")).select("ts", "i", first.alias("a"), last.alias("b")).collect()
    assert all(r["a"] <= r["ts"] < r["b"] for r in rows)
    assert {r["i"] for r in rows} == set(range(18))
    assert max(r["b"] for r in rows) == dt.datetime(2026, 9, 1)


NUMBERS = ["0.5", " 0.5 ", "1e-3", "nan", "inf", "-inf", "Infinity", "1d", "1f", "abc", "", "1_0", "True",
           "-0.0", "+3", ".5", "5.", "1e400", "0x1p3", "1D", "2.5F ", None]


def test_to_number_equals_pandas(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        expected = [None if math.isnan(v) else v for v in pd.to_numeric(pd.Series(NUMBERS, dtype=object), errors="coerce")]
    assert column(spark, NUMBERS, text.to_number) == expected


def test_to_number_of_a_double(spark):
    assert column(spark, [0.25, float("nan"), None], text.to_number, "double") == [0.25, None, None]


def test_numeric_guards(spark):
    row = spark.createDataFrame([(3, 0, float("nan"))], "a long, b long, c double").select(
        numeric.ratio(F.col("a"), F.col("b")).alias("zero"),
        numeric.ratio(F.col("a"), F.col("b"), float("inf")).alias("inf"),
        numeric.nan_to_zero(F.col("c")).alias("nan"),
        numeric.engagement(F.col("a"), F.lit(None), F.col("b")).alias("sum"),
        numeric.token_cost(F.lit(1_000_000_000)).alias("cost"),
        numeric.sigmoid(F.lit(0.0)).alias("half")).first()
    assert tuple(row) == (0.0, float("inf"), 0.0, 3, 42.0, 0.5)


def test_masked_mean(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 0, [9.0, 9.0]), (1, 1, [3.0, 6.0]), (2, 0, [5.0, 5.0])],
                                 "doc int, mask int, v array<double>")
    found = rows.groupBy("doc").agg(numeric.masked_mean(F.col("v"), F.col("mask"), 2).alias("m")).collect()
    assert {r["doc"]: r["m"] for r in found} == {1: [2.0, 4.0], 2: [0.0, 0.0]}


@pytest.mark.parametrize("partitions", [1, 7])
def test_means_of_long_vectors_of_a_hot_key(spark, monkeypatch, partitions):
    monkeypatch.setattr(pooling, "NUMBERS_AT_ONCE", 2000)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 768))
    doc = [None if i % 10 == 0 else float("nan") if i % 10 == 1 else 0.0 if i % 2 else float(i) for i in range(300)]
    mask = [1 if i % 3 else 0 for i in range(300)]
    rows = spark.createDataFrame([(d, "x", m, v.tolist()) for d, m, v in zip(doc, mask, vectors)],
                                 "doc double, part string, mask int, v array<double>").repartition(partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 32)
    try:
        found = pooling.mean_pooled(rows, ["doc", "part"], "v", "mask", 768).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {}
    for d, m, v in zip(doc, mask, vectors):
        expected.setdefault(repr(d), []).append((m, v))
    assert sorted(repr(r["doc"]) for r in found) == sorted(expected)
    for r in found:
        kept = [v for m, v in expected[repr(r["doc"])] if m]
        assert r["pooled"] == pytest.approx(np.mean(kept, axis=0) if kept else np.zeros(768))


def test_means_of_vectors_with_holes(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, None]), (1, None, [9.0, 9.0]), (1, 1, None), (2, 1, None)],
                                 "doc int, mask int, v array<float>")
    found = {r["doc"]: r["pooled"] for r in pooling.mean_pooled(rows, ["doc"], "v", "mask", 2).collect()}
    assert found == {1: [1.0, 0.0], 2: [0.0, 0.0]}
    assert pooling.mean_pooled(rows.limit(0), ["doc"], "v", "mask", 2).collect() == []
    with pytest.raises(Exception, match="not 3 components: 2"):
        pooling.mean_pooled(rows, ["doc"], "v", "mask", 3).collect()


def test_collected_at_is_one_time_of_the_run(spark):
    before = dt.datetime.now().timestamp()
    times = {r[0].timestamp() for r in spark.range(100).repartition(4).select(clock.collected_at()).collect()}
    assert len(times) == 1 and before - 1e-3 <= times.pop() <= dt.datetime.now().timestamp()


def test_linear_head(spark):
    row = spark.createDataFrame([([1.0, 2.0],)], "v array<float>").select(
        numeric.linear_head(F.col("v"), [0.5, -1.0], 0.25)).first()
    assert row[0] == -1.25


def test_tails_against_known_values():
    # Two-sided 5% points of t, upper 5% points of F and chi-square tables.
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert tails.t_quantile(0.975, 1) == pytest.approx(12.70620474, abs=1e-7)
    assert tails.t_two_sided(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-6)
    assert tails.f_upper(3.708264, 3, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_two_df_upper(5.991464547) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_upper(4.0, 1, 12) == pytest.approx(tails.t_two_sided(2.0, 12), abs=1e-12)
