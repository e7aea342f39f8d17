import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from posthaste.operators import dedupe, encoding, filters, keywords, ranks, reports, rubric, splits, stats, training
from posthaste.plans import curate, explore
from posthaste.sources import samples

AT = "Wed Aug 12 14:23:01 +0000 2026"
POST = "tweet_id string, text string, created_at string, likes long, replies long, reposts long, ord long"


def posts(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], POST)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- filters ---------------------------------------------------------------

def test_candidate_bounds(spark):
    long = "x" * 60
    rows = posts(spark, [
        ("short", "x" * 49, AT, 50, 0, 0), ("low", "x" * 50, AT, 50, 0, 0),
        ("high", "x" * 280, AT, 50, 0, 0), ("over", "x" * 281, AT, 50, 0, 0),
        ("emoji", "😀" * 50, AT, 50, 0, 0), ("padded", "　 " + "x" * 50 + "\n", AT, 50, 0, 0),
        ("padded short", " " * 10 + "x" * 45, AT, 50, 0, 0), ("no text", None, AT, 50, 0, 0),
        ("start", long, "Thu Jan 01 00:00:00 +0000 2026", 50, 0, 0),
        ("before", long, "Wed Dec 31 23:59:59 +0000 2025", 50, 0, 0),
        ("end", long, "Tue Sep 01 00:00:00 +0000 2026", 50, 0, 0),
        ("last", long, "Mon Aug 31 23:59:59 +0000 2026", 50, 0, 0),
        ("zone", long, "Tue Sep 01 02:00:00 +0530 2026", 50, 0, 0),
        ("no date", long, None, 50, 0, 0), ("bad date", long, "garbage", 50, 0, 0),
        ("49", long, AT, 49, None, None), ("sum", long, AT, None, 20, 30), ("none", long, AT, None, None, None)])
    kept = {r["tweet_id"]: r for r in filters.candidates(rows).collect()}
    assert set(kept) == {"low", "high", "emoji", "padded", "start", "last", "zone", "sum"}
    assert kept["padded"]["text"] == "x" * 50
    assert (kept["sum"]["likes"], kept["sum"]["engagement_total"]) == (0, 50)
    funnel = {r["reason"]: r["posts"] for r in filters.candidate_funnel(rows).collect()}
    assert funnel == {"kept": 8, "length": 4, "date": 4, "engagement": 2}


def test_rejected_first_copy_uses_up_the_id(spark):
    rows = posts(spark, [("a", "x" * 60, AT, 40, 0, 0), ("a", "x" * 60, AT, 60, 0, 0),
                         ("b", "x" * 60, AT, 60, 0, 0), ("b", "x" * 60, AT, 40, 0, 0)])
    found = curate.collect(rows, rows.filter("false"), "ord").collect()
    assert [(r["tweet_id"], r["engagement_total"]) for r in found] == [("b", 60)]


def test_rejected_id_may_come_back_in_a_later_run(spark, folder):
    table = f"{folder}/accepted"
    early = posts(spark, [("a", "x" * 60, AT, 40, 0, 0), ("b", "y" * 60, AT, 60, 0, 0)])
    late = posts(spark, [("a", "x" * 60, AT, 60, 0, 0), ("b", "z" * 60, AT, 99, 0, 0)])
    source = F.lit("k").alias("query_source")
    curate.collect_into(table, early.select("*", source), "ord")
    for _ in range(2):  # a second run with the same posts adds nothing
        done = curate.collect_into(table, late.select("*", source), "ord")
        assert {(r["tweet_id"], r["text"][0]) for r in done.collect()} == {("a", "x"), ("b", "y")}
        assert done.count() == 2


def test_empty_batch_writes_nothing(spark, folder):
    from posthaste.sources.tables import path_exists
    rows = posts(spark, []).withColumn("query_source", F.lit("k"))
    assert curate.collect_into(f"{folder}/t", rows, "ord").count() == 0
    assert not path_exists(spark, f"{folder}/t")


def test_range_is_checked_before_duplicates_go(spark):
    schema = "ord long, text string, score string"
    bad = spark.createDataFrame([(0, "a", "0.5"), (1, "a", "1.0001")], schema)
    with pytest.raises(ValueError, match="1 rows"):
        training.prepare_training(bad)
    edges = spark.createDataFrame([(0, "a", "0"), (1, "b", "1"), (2, " a ", "0.5"), (3, "c", "nan"),
                                   (4, " ", "0.1"), (5, None, "0.1"), (6, "d", "x")], schema)
    with pytest.warns(UserWarning):
        rows = training.prepare_training(edges).orderBy("ord").collect()
    assert [tuple(r) for r in rows] == [(0, "a", 0.0), (1, "b", 1.0)]
    infinite = spark.createDataFrame([(0, "a", "inf")], schema)
    with pytest.raises(ValueError):
        training.prepare_training(infinite)
    with pytest.raises(ValueError, match="score"):
        training.prepare_training(edges.drop("score"))


def test_keywords_equal_brute_force(spark, monkeypatch):
    texts = ["Climate Change is here", "climate", "the CHANGE of heart", "xx", None, "a b", "tax taxes", "ΑΒΓ Climate",
             "x" * 60 + "line\nbreak 😀 emoji", "", "😀😀 emoji"]
    words = ["change", "climate change", "tax", "b", "heart", "αβγ", "climate", "", "zzzzzzzz", "xline\nbreak", "😀 emo",
             "  ", " of", "the change "]
    rows = spark.createDataFrame(
        [(i, t, "en", 20, "2026-02-01 00:00:00") for i, t in enumerate(texts)],
        "ord long, text string, lang string, likes long, created_ts string").withColumn(
        "created_ts", F.col("created_ts").cast("timestamp"))
    table = spark.createDataFrame(list(enumerate(words)), "kw_id int, keyword string")
    expected = {i: next(w for w in words if w and w in t.lower()) for i, t in enumerate(texts)
                if t and any(w and w in t.lower() for w in words)}
    for size in (2, 4):
        monkeypatch.setattr(keywords, "ANCHOR", size)
        found = keywords.keyword_candidates(rows, table)
        assert {r["ord"]: r["query_source"] for r in found.collect()} == expected
    assert keywords.keyword_candidates(rows, table.filter("false")).count() == 0


def test_keywords_with_repeated_and_missing_keys(spark):
    rows = spark.createDataFrame([(None, "x then"), (1, "A House then"), (1, "x3"), (1, "x3"), (2, None), (3, "none")],
                                 "ord long, text string").selectExpr(
        "*", "'en' as lang", "20 as likes", "timestamp'2026-02-01' as created_ts")
    table = spark.createDataFrame([(1, "then"), (1, "House"), (0, "x3"), (None, "x"), (2, ""), (3, None), (5, "THEN")],
                                  "kw_id long, keyword string")
    for strategy in (None, "merge"):
        found = keywords.keyword_candidates(rows, table, strategy=strategy).collect()
        assert sorted(((r["ord"], r["text"], r["query_source"]) for r in found), key=str) == [
            (1, "A House then", "House"), (1, "x3", "x3"), (1, "x3", "x3"), (None, "x then", "then")]


def test_dates_reach_the_scan(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("ts", "created_ts")
    text = plan(filters.in_window(rows, "2024-01-01", "2024-01-02"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in text


def test_cuts_keep_every_row(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d"), (None, "e"), (None, "f")], "ord long, t string")
    for n in range(8):
        head, rest = (part.collect() for part in splits.split_at(rows, n))
        assert len(head) == min(n, 6) and sorted(r["t"] for r in head + rest) == list("abcdef")
        key = lambda r: (r["ord"] is None, r["ord"] or 0)
        assert not head or not rest or max(map(key, head)) <= min(map(key, rest))
        assert filters.take_until(rows, n + 2, 2).count() == min(n, 6)
    assert sorted(r["chunk_id"] for r in splits.assign_chunks(rows, 4).collect()) == [0, 0, 0, 0, 1, 1]
    equal = spark.createDataFrame([(1, "a"), (1, "a"), (2, "d")], "ord long, t string")
    for n in range(4):
        head, rest = splits.split_at(equal, n)
        assert sorted(r["t"] for r in head.collect()) == list("aad")[:n]
        assert sorted(r["t"] for r in rest.collect()) == list("aad")[n:]


def test_positions_by_columns_of_any_type(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("a", 1)], "k string, v int")
    placed, path = ranks.with_position(rows, ["k", "v"], "position")
    assert {(r["k"], r["v"]): r["position"] for r in placed.collect()} == {
        ("a", 1): 0, ("a", 2): 1, ("b", 1): 2, (None, 3): 3}


def test_a_second_label_goes_by_order(spark):
    rows = spark.createDataFrame([(1, "h", 1, 2), (1, "h", 0, 1), (1, "m", 0, 1), (2, "h", 1, 1), (2, "m", 1, 1)],
                                 "item long, rater string, label int, at int")
    assert stats.agreement(rows, ["h", "m"], order="at").first()["agreement"] == 1.0
    assert stats.agreement(rows.withColumn("at", -F.col("at")), ["h", "m"], order="at").first()["agreement"] == 0.5


# --- duplicates ----------------------------------------------------------------

def test_null_texts_are_one_group(spark):
    rows = spark.createDataFrame([(0, None), (1, " a"), (2, None), (3, "a\n")], "ord long, text string")
    assert sorted((r["ord"], r["text"]) for r in dedupe.clean(rows).collect()) == [(0, None), (1, "a")]
    assert sorted((r["ord"], r["text"]) for r in dedupe.dedupe_text(rows).collect()) == [(0, None), (1, "a")]


def test_hot_key_is_limited_before_the_shuffle(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
    kept = dedupe.keep_first(rows, ["k"], "id")
    text = plan(kept)
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")
    assert kept.count() == rows.select("k").distinct().count()
    assert kept.filter("k = 0").first()["id"] == 0


def test_clean_aggregates_before_the_shuffle(spark, sf):
    text = plan(dedupe.clean(samples.posts(spark, sf)))
    assert "SortAggregate" not in text and "partial_min" in text


def test_patch_changes_failed_rows_only(spark):
    base = spark.createDataFrame([(0, None, "x"), (1, 0.5, "y"), (2, float("nan"), None), (3, None, None)],
                                 "ord long, ragebait double, kind string")
    redo = spark.createDataFrame([(0, 0.1, "r"), (1, 0.9, "r"), (2, 0.2, "r")], base.schema)
    found = dedupe.patch_results(base, redo, ["ragebait", "kind"]).orderBy("ord").collect()
    assert [tuple(r) for r in found] == [(0, 0.1, "r"), (1, 0.5, "y"), (2, 0.2, "r"), (3, None, None)]


# --- ranks and splits ------------------------------------------------------------

@pytest.mark.parametrize("rows_per_range", [7, 1_000_000])
@pytest.mark.parametrize("partitions", [1, 5])
def test_ordinal_is_exact_for_any_layout(spark, rows_per_range, partitions):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009 - 300).alias("k")).repartition(partitions)
    placed = ranks.with_ordinal(rows, ranks.by_column("k"), "o", rows_per_range).orderBy("k").collect()
    assert [r["o"] for r in placed] == list(range(1000))


def test_ordinal_never_gathers_the_table(spark):
    rows = spark.range(1000)
    assert "SinglePartition" not in plan(ranks.with_ordinal(rows, ranks.by_column("id")))
    assert "SinglePartition" not in plan(ranks.with_ordinal(rows, ranks.seeded(1, "id")))


def test_rank_lookup_narrows_down(spark, monkeypatch):
    monkeypatch.setattr(ranks, "MAX_SORTED_KEYS", 40)
    # A third of the range holds nearly all keys.
    rows = spark.range(2000).select(F.when(F.col("id") < 1900, F.col("id")).otherwise(F.col("id") * 10**9).alias("k"))
    ordered = sorted(r["k"] for r in rows.collect())
    found = ranks._keys_at(rows, ranks.by_column("k"), [0, 1, 777, 1899, 1900, 1999, 2000, -1], 2000)
    assert {r: (f.key, f.first, f.equal) for r, f in found.items()} == {
        i: (ordered[i], i, 1) for i in (0, 1, 777, 1899, 1900, 1999)}
    same = spark.range(200).select(F.lit(1).alias("k"))
    assert [part.count() for part in ranks.cut_at(same, ranks.by_column("k"), 5)] == [5, 195]
    # Longs that differ by less than a double can tell, and a value of a third of all rows.
    near = spark.range(600).select((F.lit(2 ** 60) + F.floor(F.col("id") / 3)).alias("k"), "id")
    hot = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), "id")
    for rows in (near, hot):
        ids = []
        for n in (1, 100, 299, 450, 599):
            head, rest = (part.collect() for part in ranks.cut_at(rows, ranks.by_column("k"), n))
            assert len(head) == n and len(rest) == 600 - n
            last = lambda r: (r["k"] is None, r["k"] or 0)
            assert max(map(last, head)) <= min(map(last, rest))
            ids.append({r["id"] for r in head})
        assert all(a < b for a, b in zip(ids, ids[1:]))


@pytest.mark.parametrize("keys", [[1, 1, 1, 1, 5, 6], [None, None, 1, 2, 3], [7] * 5, [None] * 4])
@pytest.mark.parametrize("apart", [True, False])
def test_sizes_with_tied_keys(spark, keys, apart):
    rows = spark.createDataFrame([(k, i if apart else 0) for i, k in enumerate(keys)], "ord long, x long")
    listed = sorted(rows.collect(), key=str)
    folds = splits.kfold(rows, 3)
    assert folds.columns == ["ord", "x", "fold"]
    assert sorted((r[:2] for r in folds.collect()), key=str) == sorted((tuple(r) for r in listed), key=str)
    sizes = [r["count"] for r in folds.groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [len(keys) // 3 + (i < len(keys) % 3) for i in range(3)]
    assert splits.sample_n(rows, 2).count() == 2 and splits.sample_n(rows, 9).count() == len(keys)
    train, test = splits.holdout(rows, 0.4)
    assert test.count() == math.ceil(0.4 * len(keys))
    assert sorted(train.unionByName(test).collect(), key=str) == listed


def test_hot_order_keys_fill_several_ranges(spark):
    for value in (0, None):
        hot = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.lit(value)).alias("k"), "id")
        placed = ranks.with_ordinal(hot, ranks.by_column("k"), "o", 300)
        rows = placed.orderBy("o").collect()
        assert [r["o"] for r in rows] == list(range(9000))
        keys = [(r["k"] is None, r["k"] or 0) for r in rows]
        assert keys == sorted(keys)
        bounds, parts = ranks._split_bounds(hot.select(ranks.by_column("k").positions[0].alias("_at")),
                                            ranks.by_column("k"), 9000, 30)
        assert max(parts) >= 9 and len(bounds) + 1 == len(parts)


@pytest.mark.parametrize("n", [3, 4, 5, 1000])
@pytest.mark.parametrize("k", [3, 5])
def test_fold_sizes(spark, n, k):
    rows = spark.range(n).withColumnRenamed("id", "ord")
    if n < k:
        with pytest.raises(ValueError):
            splits.kfold(rows, k)
        return
    sizes = [r["count"] for r in splits.kfold(rows, k).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [n // k + (i < n % k) for i in range(k)]


def test_splits_do_not_depend_on_layout(spark):
    rows = spark.range(500).withColumnRenamed("id", "ord")
    def drawn(df):
        train, test = splits.holdout(df, 0.05)
        assert (train.count(), test.count()) == (475, 25)
        assert train.join(test, "ord").count() == 0
        return (frozenset(r["ord"] for r in test.collect()),
                frozenset(r["ord"] for r in splits.sample_n(df, 298).collect()))
    first, second = drawn(rows), drawn(rows.repartition(11).orderBy(F.desc("ord")))
    assert first == second and len(first[1]) == 298
    assert splits.sample_n(rows, 9999).count() == 500
    assert first[0] != frozenset(r["ord"] for r in splits.holdout(rows, 0.05, seed=7)[1].collect())


def test_splits_do_not_shuffle_rows(spark, sf):
    rows = samples.table(spark, sf, "documents").withColumnRenamed("doc_id", "ord")
    for part in (*splits.split_at(rows, 50), *splits.holdout(rows), splits.kfold(rows), splits.sample_n(rows, 30)):
        assert "Exchange" not in plan(part)
    assert "LessThan(doc_id,50)" in plan(splits.split_at(rows, 50)[0])


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 20])
def test_chunk_sizes(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "ord")
    sizes = [r["count"] for r in splits.assign_chunks(rows, 10).groupBy("chunk_id").count().orderBy("chunk_id").collect()]
    assert sizes == [min(10, n - s) for s in range(0, n, 10)]


def test_split_past_the_end(spark):
    head, rest = splits.split_at(spark.range(5).withColumnRenamed("id", "ord"), 9)
    assert (head.count(), rest.count()) == (5, 0)


def test_take_until(spark):
    rows = spark.range(100).withColumnRenamed("id", "ord")
    assert [r["ord"] for r in filters.take_until(rows, 12, existing=10).collect()] == [0, 1]
    assert filters.take_until(rows, 5, existing=10).count() == 0


# --- statistics --------------------------------------------------------------------

def average_ranks(values):
    values = np.asarray(values)
    return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])


@pytest.mark.parametrize("rows_per_range", [5, 1_000_000])
def test_spearman_with_ties(spark, rows_per_range):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 6, 120), rng.integers(0, 40, 120)
    rows = spark.createDataFrame([(int(i % 2), float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))],
                                 "g int, a double, b double")
    found = {r["g"]: r["spearman"] for r in stats.spearman(rows, "a", "b", ["g"], rows_per_range).collect()}
    for g in (0, 1):
        assert found[g] == pytest.approx(np.corrcoef(average_ranks(a[g::2]), average_ranks(b[g::2]))[0, 1])


def test_spearman_of_a_constant_is_zero(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0), (float("nan"), 5.0)], "a double, b double")
    assert stats.spearman(rows, "a", "b").first()[0] == 0.0


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    x[:, 2] = 0.8 * x[:, 0] + 0.3 * x[:, 2] + 5
    y = 2 + x @ [1.0, -2.0, 0.5] + rng.normal(size=300)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    rows += [(300, None, 1.0, 2.0, 3.0), (301, 1.0, float("nan"), 2.0, 3.0)]
    return spark.createDataFrame(rows, "ord long, a double, b double, c double, y double").repartition(4), x, y


def test_correlation_equals_numpy_and_skips_missing_pairs(spark, numbers):
    df, x, _ = numbers
    found = {(r["a"], r["b"]): r["r"] for r in stats.corr_matrix(df.filter("ord < 300"), ["a", "b", "c"]).collect()}
    expected = np.corrcoef(x.T)
    for (i, p), (j, q) in itertools.product(enumerate("abc"), repeat=2):
        assert found[p, q] == pytest.approx(expected[i, j])
    assert stats.corr_matrix(df, ["a", "b"]).count() == 4
    # Each pair drops its own incomplete rows, as pandas does.
    pdf = df.toPandas()
    holes = {(r["a"], r["b"]): r["r"] for r in stats.corr_matrix(df, ["a", "b", "c"]).collect()}
    for p, q in itertools.product("abc", repeat=2):
        assert holes[p, q] == pytest.approx(pdf[["a", "b", "c"]].corr().loc[p, q])
    constant = df.withColumn("k", F.lit(0.1))
    assert {r["r"] for r in stats.corr_matrix(constant, ["k", "a"]).filter("a = 'k' or b = 'k'").collect()} == {None}


def test_vif_equals_least_squares(spark, numbers):
    df, x, _ = numbers
    found = {r["variable"]: r["vif"] for r in stats.vif(df, ["a", "b", "c"]).collect()}
    design = np.column_stack([np.ones(300), x])
    for j, name in enumerate(["const", "a", "b", "c"]):
        others = np.delete(design, j, axis=1)
        rest = design[:, j] - others @ np.linalg.lstsq(others, design[:, j], rcond=None)[0]
        total = design[:, j] if j == 0 else design[:, j] - design[:, j].mean()
        assert found[name] == pytest.approx(total @ total / (rest @ rest))


def test_vif_of_collinear_columns(spark, numbers):
    df, _, _ = numbers
    found = {r["variable"]: r["vif"] for r in stats.vif(df.withColumn("s", F.col("a") + F.col("b")), ["a", "b", "s", "c"]).collect()}
    assert found["a"] == found["b"] == found["s"] == float("inf")
    assert found["c"] < 100


def test_ols_equals_numpy(spark, numbers):
    df, x, y = numbers
    table, summary = stats.ols(df, "y", ["a", "b", "c"], order="ord", rows_per_range=20)
    design = np.column_stack([np.ones(300), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    e = y - design @ beta
    err = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * (e @ e) / 296)
    rows = {r["variable"]: r for r in table.collect()}
    for name, b, s in zip(["const", "a", "b", "c"], beta, err):
        assert rows[name]["coef"] == pytest.approx(b)
        assert rows[name]["std_err"] == pytest.approx(s)
        assert rows[name]["ci_high"] - rows[name]["coef"] == pytest.approx(1.968011 * s, rel=1e-5)
    found = {r["measure"]: r["value"] for r in summary.collect()}
    m2, m3, m4 = ((e ** k).mean() for k in (2, 3, 4))
    assert found["r_squared"] == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum())
    assert found["durbin_watson"] == pytest.approx((np.diff(e) ** 2).sum() / (e @ e))
    assert found["skew"] == pytest.approx(m3 / m2 ** 1.5)
    assert found["kurtosis"] == pytest.approx(m4 / m2 ** 2)
    assert found["condition_number"] == pytest.approx(np.linalg.cond(design))
    assert found["log_likelihood"] == pytest.approx(-150 * (np.log(2 * np.pi * e @ e / 300) + 1))
    assert found["n_obs"] == 300


def test_least_squares_moves_no_rows(spark, numbers):
    df, _, _ = numbers
    stored = df.select("a", "b")
    m = stats.moments(stats.complete_cases(stored, ["a", "b"]), ["a", "b"])
    assert m.n == 300 or m.n == 301
    assert m.cross.shape == (2, 2)


def test_pair_bins_put_the_maximum_in_the_last_bin(spark):
    rows = spark.createDataFrame([(float(v), 1.0) for v in range(11)], "a double, k double")
    found = stats.pair_bins(rows, ["a", "k"], 5).collect()
    diagonal = {r["bin_x"]: r["n"] for r in found if r["x"] == r["y"] == "a"}
    assert diagonal == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3}
    assert {r["bin_y"] for r in found if r["y"] == "k"} == {1}


def test_agreement_of_equal_and_opposite_raters(spark):
    rows = [(i, r, lab) for i in range(10) for r, lab in (("a", i % 2), ("b", i % 2), ("c", 1 - i % 2))]
    found = {(r["rater_a"], r["rater_b"]): r for r in stats.agreement(
        spark.createDataFrame(rows, "item int, rater string, label int"), ["a", "b", "c"]).collect()}
    assert (found["a", "b"]["agreement"], found["a", "b"]["kappa"]) == (1.0, 1.0)
    assert (found["a", "c"]["agreement"], found["a", "c"]["kappa"]) == (0.0, -1.0)


def test_best_trial_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(2, 0.1), (1, 0.1), (0, 0.3)], "trial int, mae double")
    assert stats.best_trial(rows).first()["trial"] == 1


# --- encoding and rubric --------------------------------------------------------------

def test_dummies_skip_the_first_category(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "k string")
    found = encoding.dummies(rows, ["k"])
    assert found.columns == ["k_b", "k_c"]
    assert sorted(tuple(r) for r in found.collect()) == [(0, 0), (0, 0), (0, 1), (1, 0)]
    assert encoding.dummies(rows, ["k"], {"k": ["x", "a", "b"]}).columns == ["k_b", "k_x"]


def test_dummies_refuse_too_many_categories(spark, monkeypatch):
    monkeypatch.setattr(encoding, "MAX_CATEGORIES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        encoding.dummies(spark.range(5), ["id"])


def test_rubric_has_48_options(spark):
    options = rubric.rubric_options(rubric.rubric(spark))
    assert options.count() == 48
    sizes = {r["question"]: r["count"] for r in options.groupBy("question").count().collect()}
    assert set(sizes) == set(rubric.QUESTIONS)
    assert [sizes[q] for q in rubric.NOUL] == [2, 2]
    assert {sizes[q] for q in rubric.SCORES} == {5} and {sizes[q] for q in rubric.CHOICES} == {7}
    baselines = [min(rubric.QUESTIONS[q]["criteria"]) for q in rubric.CHOICES]
    assert baselines == ["claim", "abstract_issue"]


def test_bad_reply_gives_missing_answers(spark):
    rows = spark.createDataFrame([(0, '{"usage": {"input_tokens": 5}, "answers": {"ragebait": {"noul": 0.5}}}'),
                                  (1, "not json"), (2, None)], "ord long, reply string")
    found = rubric.flatten_answers(rows).orderBy("ord").collect()
    assert (found[0]["input_tokens"], found[0]["ragebait"], found[0]["nicheness"]) == (5, 0.5, None)
    assert found[1]["ragebait"] is None and found[2]["input_tokens"] is None


def test_explore_gives_every_report(spark, sf):
    found = explore.explore(samples.annotated(spark, sf))
    assert {n: df.count() > 0 for n, df in found.items()} == dict.fromkeys(
        ["profile", "pairs", "correlation", "vif", "coefficients", "fit"], True)
    variables = [r["variable"] for r in found["coefficients"].collect()]
    assert "input_tokens" in variables and "content_type_claim" not in variables


def test_explore_scans_four_times_and_equals_the_parts(spark, sf, folder):
    samples.annotated(spark, sf).withColumn("ragebait", F.when(F.col("ord") % 9 > 0, F.col("ragebait"))).write.parquet(
        f"{folder}/t")
    table = spark.read.parquet(f"{folder}/t")
    rows, read = table.count(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    found = {name: df.collect() for name, df in explore.explore(table.mapInArrow(counted, table.schema)).items()}
    assert read.value <= 4 * rows
    numbers = [c for c in stats.numeric_columns(table) if c != "ord"]
    assert found["profile"] == stats.profile(table).collect()
    assert sorted(found["pairs"]) == sorted(stats.pair_bins(table, numbers).collect())
    for name, alone in (("correlation", stats.corr_matrix(table, numbers)), ("vif", stats.vif(table, numbers))):
        for shared, single in zip(found[name], alone.collect(), strict=True):
            assert shared[:-1] == single[:-1]
            assert shared[-1] == (single[-1] if single[-1] is None else pytest.approx(single[-1], nan_ok=True))
    encoded = encoding.dummies(table.drop("text"), explore.LABELS[1:])
    predictors = [c for c in encoded.columns if c not in ("ord", "ragebait")]
    for shared, single in zip(found["coefficients"], stats.ols(encoded, "ragebait", predictors)[0].collect(), strict=True):
        assert shared[0] == single[0] and shared[1] == pytest.approx(single[1], abs=1e-9)


def test_overview_of_labels(spark):
    rows = spark.createDataFrame([("a", None, 1.0), ("b", "x", float("nan")), (None, "x", 3.0), ("a", None, None)],
                                 "p string, q string, v double")
    seen = stats.overview(rows, ["p", "q"])
    assert seen == stats.Overview({"p": 3, "q": 2, "v": 2}, {"v": 2.0}, {"v": (1.0, 3.0)}, {"p": ["a", "b"], "q": ["x"]})
    none = stats.overview(rows.limit(0), ["p", "q"])
    assert none == stats.Overview({"p": 0, "q": 0, "v": 0}, {"v": 0.0}, {"v": (None, None)}, {"p": [], "q": []})
    with pytest.raises(ValueError, match="more than 2 categories"):
        stats.overview(rows, ["p", "q"], most=2)


def test_reports_of_an_empty_run(spark, sf):
    none = samples.annotated(spark, sf).filter("false")
    assert tuple(reports.cost_report(none).first()) == (0, 0, 0, 0, 0.0)
