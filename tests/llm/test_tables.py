"""Sharding, mixing, URL rules, top-k search and the pipeline against plain versions."""

import collections
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
import corpus_pipeline
from posthaste.llm import decontaminate, mixing, near_dup, nearest, quality, queries, sharding, url_filter
from posthaste.sources.tables import stored

NON_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert compare.mismatch(spark, compare.database(folder), folder, name) is None


@pytest.mark.parametrize("name, table", [
    ("op2_shards", "documents"), ("op5_licenses", "documents"), ("op6_quality", "documents"),
    ("op9_secrets", "documents"), ("op10_mixture", "documents")])
def test_query_returns_a_row_per_document(spark, sf, name, table):
    found = queries.QUERIES[name](spark, sf)
    ids = sorted(r.doc_id for r in found.select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/{table}.parquet").select("doc_id").collect())


def plain_best_fit(sizes, capacity):
    rooms, bins = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fitting = [(room, b) for b, room in enumerate(rooms) if room >= sizes[i]]
        if fitting:
            bins[i] = min(fitting)[1]
        else:
            bins[i] = len(rooms)
            rooms.append(max(capacity, sizes[i]))
        rooms[bins[i]] -= sizes[i]
    return bins


def test_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.choice([1, 5, 30, rng.randint(1, 120)]) for _ in range(rng.randint(0, 300))]
        assert sharding.best_fit_decreasing(sizes, 100) == plain_best_fit(sizes, 100)
    many = [rng.randint(1, 1000) for _ in range(3000)]
    bins = sharding.fewest_bytes(many, 8)
    loads = collections.Counter()
    for size, b in zip(many, bins):
        loads[b] += size
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) < 1000
    assert sharding.fewest_bytes([], 8) == []


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, shard int, _a int")


def check_shards(rows, count):
    slots = collections.defaultdict(list)
    loads = collections.Counter()
    for r in rows:
        assert r.size == (len(r.text.encode()) if r.text is not None else 0) + 1
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert set(slots) <= set(range(count))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return loads


def test_shards_of_groups(spark):
    rng = random.Random(2)
    texts = ["é" * rng.randint(0, 60) + str(rng.randint(0, 300)) for _ in range(3000)] + [None] * 40 + [""] * 3
    rows = [(i, t, "s", "x", 5, 1) for i, t in enumerate(texts)] + [(None, "no id", "s", "x", 5, 1)] * 4
    found = sharding.shard(documents(spark, rows))
    assert found.columns == ["doc_id", "text", "source", "_a", "size", "shard", "slot"]
    found = found.collect()
    loads = check_shards(found, 8)
    assert len(found) == len(rows) and len(loads) == 8
    assert max(loads.values()) - min(loads.values()) <= 0.02 * sum(loads.values()) / 8
    homes = collections.defaultdict(set)
    for r in found:
        homes[r.text].add(r.shard)
    assert all(len(x) == 1 for x in homes.values())


def test_shards_cut_a_group_that_is_larger_than_a_shard(spark):
    rows = [(i, "a copied text " * 9 if i % 3 else f"{i} own", "s", "x", 5, 1) for i in range(3000)]
    found = sharding.shard(documents(spark, rows)).collect()
    loads = check_shards(found, 8)
    assert max(loads.values()) - min(loads.values()) <= 0.05 * sum(loads.values()) / 8


def test_shards_of_fixed_capacity(spark):
    rows = [(i, "x" * (i % 50), "s", "x", 5, 1) for i in range(2000)]
    found = sharding.shard(documents(spark, rows), shards=None, capacity=5000).collect()
    loads = check_shards(found, 1000)
    assert max(loads.values()) <= 5000 and len(loads) <= sum(loads.values()) / 5000 + 2
    assert sharding.shard(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        sharding.shard(documents(spark, []), shards=None)


def test_shard_query(spark, sf):
    rows = {r.doc_id: r for r in queries.op2_shards(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(docs) == len(rows)
    for d in docs:
        r = rows[d.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (
            len(d.text.encode()) + 1, zlib.crc32(d.text.encode()), "bytes", None)
    again = {r.doc_id: r for r in queries.op2_shards(spark, sf).collect()}
    assert again == rows


def water_filled(sizes, weights=(5, 2, 1), percent=150, repeats=2):
    """Targets by resharing the excess until no source is above its most."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, stopped = percent * sum(sizes.values()) / 100, {}
    while True:
        free = [s for s in names if s not in stopped]
        total = sum(weight[s] for s in free)
        rest = left - sum(stopped.values())
        over = [s for s in free if rest * weight[s] > repeats * sizes[s] * total]
        if not over:
            return {**stopped, **{s: rest * weight[s] / total for s in free}}
        stopped.update({s: float(repeats * sizes[s]) for s in over})


@pytest.fixture(scope="module")
def mixed_docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(2500):
        source = rng.choice(["hot"] * 9 + ["b", "C", "é", None, "\U0001F600", "tiny"] if i else ["one word"])
        words = 1 if source in ("tiny", "one word") else rng.choice([0, 1, 5, 40, 200])
        rows.append((i, " \t".join(["w"] * words) + rng.choice(["", " ", "\n"]), source))
    rows += [(None, "no id", "b"), (7, None, "b"), (8, "", None), (9, "a b", "b"), (9, "a b", "b"),
             (10, "long " * 30_000, "C"), (11, None, "only empty")]
    return spark.createDataFrame([(*r, 3, 4.5) for r in rows],
                                 "doc_id long, text string, source string, start int, target double")


def test_mixture(mixed_docs):
    found = mixing.taken(mixed_docs).collect()
    docs = mixed_docs.collect()
    sizes = collections.Counter()
    for d in docs:
        sizes[d.source] += len(NON_SPACE.findall(d.text or ""))
    want = water_filled(sizes)
    assert len(found) == len(docs)
    sums = collections.Counter()
    for r in found:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        sums[r.source] += r.taken
    for source, target in want.items():
        assert abs(sums[source] - target) <= max(2, 0.005 * target)
    assert sum(r.size for r in found) == sum(sizes.values())
    key = lambda rows: sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in rows)
    assert key(mixing.taken(mixed_docs.repartition(7)).collect()) == key(found)


def test_mix_interleaves_its_sources(mixed_docs):
    """Any quarter of the schedule holds the sources as the whole does."""
    rows = mixing.mix(mixed_docs).groupBy("position", "source").agg(F.sum("words").alias("words")).orderBy("position").collect()
    total = collections.Counter()
    for r in rows:
        total[r.source] += 1
    quarter = len(rows) // 4
    for part in range(4):
        seen = collections.Counter(r.source for r in rows[part * quarter:(part + 1) * quarter])
        for source in ("hot", "b", "C", "é"):
            assert abs(seen[source] / quarter - total[source] / len(rows)) < 0.02
    first = [r.epoch for r in mixing.mix(mixed_docs).select("epoch").distinct().collect()]
    assert set(first) <= {0, 1}


def test_mixed_documents(mixed_docs):
    found = mixing.mixed(mixed_docs)
    assert found.columns == mixed_docs.columns
    rows = collections.Counter(tuple(r) for r in found.collect())
    source = collections.Counter(tuple(r) for r in mixed_docs.collect())
    assert all(count <= 2 * source[row] for row, count in rows.items()) and len(rows) > 800
    assert all((row[1] or "").strip() for row in rows)
    assert mixing.taken(mixed_docs.limit(0)).collect() == [] and mixing.mixed(mixed_docs.limit(0)).collect() == []
    assert {r.taken for r in mixing.taken(mixed_docs.filter("text is null")).collect()} == {0}


def plain_rule(rules, host, path):
    fitting = [(len(rule), rule.count(".", 0, rule.index("/")), verdict == "block", rule, verdict)
               for verdict, rule in rules
               if (host == rule.partition("/")[0] or host.endswith("." + rule.partition("/")[0]))
               and path.startswith("/" + rule.partition("/")[2])]
    return max(fitting)[3:] if fitting else (None, None)


def test_url_rules(spark):
    rng = random.Random(4)
    rules = queries.URL_RULES + [("block", "a.b/x/y"), ("allow", "b/x/"), ("allow", "a.b/x/ye"), ("allow", "b/"),
                                 ("block", "c/x//"), ("block", "a.b/x/y"), ("allow", "d/q"), ("block", "d/q")]
    hosts = ["net", "x.net", "EXAMPLE.net", "example.net:80", "a.b", "c.a.b", "b", "xb", "c", ".c", "d", "", "fr.org", "e..b"]
    paths = ["", "/", "/en/", "/en", "/x/y", "/x/yes", "/x/", "/x//z", "/fr/", "/q", "//", "/de/1"]
    urls = [rng.choice(["http://", "://", "HTTPS://", "", "a://b://"]) + rng.choice(hosts) + rng.choice(paths)
            + rng.choice(["", "?a=/b://", "#x", "\n", "?", "/é"]) for _ in range(3000)] + [None, "", "://", "x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for r in url_filter.judge_urls(pages, rules).collect():
        url, host, path = urls[r.page_id], "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
            host = host.translate({c: c + 32 for c in range(65, 91)})
        rule, verdict = plain_rule(rules, host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), url
    assert url_filter.judge_urls(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.judge_urls(pages, [], "block").collect()} == {"block"}
    with pytest.raises(ValueError):
        url_filter.build_trie([("maybe", "net/")])


def plain_top(rows, k=5):
    kept = []
    for i, x in rows:
        if i is not None and x and all(v is not None and np.isfinite(v) for v in x):
            kept.append((i, tuple(int(np.floor(256 * float(v))) for v in x)))
    result = []
    for q, a in sorted(set((i, x) for i, x in kept if i % 50 == 0)):
        scored = sorted((-sum(m * n for m, n in zip(a, b)), i) for i, b in kept if i != q and len(a) == len(b))
        result += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(result)


@pytest.mark.parametrize("shape", ["clustered", "ties", "wide", "odd"])
def test_top_k(spark, monkeypatch, shape):
    monkeypatch.setattr(nearest, "STEP", 64)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(6)
    if shape == "clustered":
        data = rng.normal(size=(8, 32))[rng.integers(0, 8, 900)] * 3 + rng.normal(size=(900, 32)) * 0.05
    elif shape == "ties":
        data = rng.integers(-1, 2, size=(900, 3)).astype(float)
    elif shape == "wide":
        data = rng.normal(size=(400, 6)) * 1e6
    else:
        data = rng.normal(size=(300, 5))
    rows = [(i, [float(np.float32(v)) for v in x]) for i, x in enumerate(data)]
    if shape == "odd":
        rows += [(None, [1.0] * 5), (1000, None), (1001, []), (1002, [1.0, None, 1.0, 1.0, 1.0]), (1050, [1.0, 2.0]),
                 (1051, [float("nan")] * 5), (1052, [float("inf")] * 5), (1053, [3.0, 2.0]), (7, [9.0] * 5), (7, [9.0] * 5),
                 (50, rows[50][1])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, dim int, block int")
    vectors = nearest.quantized(table)
    found = nearest.top_k(vectors.filter("vec_id % 50 = 0"), vectors).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == plain_top(rows)


def test_top_k_of_nothing(spark):
    empty = nearest.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert nearest.top_k(empty, empty).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(50, 30)), rng.normal(size=(70, 30))
    for segments in (1, 4, 7, 30):
        bound = nearest.summary(a, segments) @ nearest.summary(b, segments).T
        assert (bound >= a @ b.T - 1e-9).all()
    assert np.allclose(nearest.summary(a, 30) @ nearest.summary(b, 30).T, a @ b.T)


def test_pipeline_stages(spark, sf):
    """Every stage against what its own input says."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, stored(stage(spark, docs, sf), name))
        docs = seen[name][1]
        if name != "shard":
            assert docs.columns == columns
    before, after = seen["quality"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in quality.score_held_out(before, labels).collect()}
    assert {r.doc_id for r in after.collect()} == {i for i, good in scores.items() if good}
    before, after = seen["near_dedup"]
    groups = near_dup.near_duplicates(before, 5, 80).collect()
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in groups}
    before, after = seen["decontaminate"]
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.contamination(before, benchmark).collect() if r.contaminated}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = seen["mix"]
    copies = collections.Counter(r.doc_id for r in after.collect())
    for r in mixing.taken(before).collect():
        assert copies[r.doc_id] == round(r.taken / r.size)
    before, after = seen["shard"]
    rows = after.collect()
    check_shards(rows, 8)
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in before.collect())


def test_pipeline_runs_on_an_empty_table(spark, folder, sf):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
    assert os.path.basename(folder).startswith("run-")
