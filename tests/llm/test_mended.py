"""Cases that earlier versions got wrong or took too long for."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from posthaste.llm import decontaminate, licenses, near_dup, nearest, url_filter


def test_every_text_of_a_repeated_doc_id_is_linked(spark):
    a, b, c = ("alpha one two three four five six", "beta seven eight nine ten eleven", "gamma red green blue white black")
    rows = [(1, a), (2, b), (3, c), (5, a), (5, b), (5, c), (6, c), (7, "nothing like it at all here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs, 3, 85).collect()}
    assert found == {(1, 1, True), *((i, 1, False) for i in (2, 3, 5, 6)), (7, 7, True)}


def test_one_row_of_a_repeated_doc_id_stays_whatever_the_layout(spark):
    rows = [(7, "first text of seven"), (7, "another text with other words"), (7, None), (8, "x y z a b c"), (None, "n"), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [sorted(map(tuple, near_dup.without_duplicates(docs.repartition(n).orderBy(order)).collect()), key=str)
            for n, order in ((1, F.col("text")), (4, F.col("text").desc()))]
    assert kept[0] == kept[1] and len(kept[0]) == 4 and (7, None) not in kept[0]


def test_many_licence_hits_take_time_in_proportion():
    begun = time.perf_counter()
    row = licenses.scan_text(b"cc by nc under the mit license " * 60_000)
    assert time.perf_counter() - begun < 10
    assert row[:4] == (420_000, 120_000, 0, 419_996)


def test_many_rules_of_one_host():
    rules = [("block", f"example.com/u{i}") for i in range(100_000)] + [("allow", "example.com/u77/x")]
    trie = url_filter.build_trie(rules)
    begun = time.perf_counter()
    for i in range(2000):
        assert url_filter.longest_match(trie, "www.example.com", f"/u{i}") == (f"example.com/u{i}", "block")
    assert time.perf_counter() - begun < 2
    assert url_filter.longest_match(trie, "example.com", "/u77/xy")[1] == "allow"
    # Only A-Z are lower-cased, in rules as in hosts.
    other = url_filter.build_trie([("block", "ÄB.Example.com/")])
    assert url_filter.longest_match(other, "Äb.example.com", "/")[1] == "block"
    assert url_filter.longest_match(other, "äb.example.com", "/") == (None, None)


@pytest.mark.parametrize("spread, most", [(0.02, 0.2), (0.3, 0.6)])
def test_bounds_spare_inner_products(spread, most):
    rng = np.random.default_rng(4)
    data = np.floor(256 * (rng.normal(size=(20, 64))[rng.integers(0, 20, 4000)] + spread * rng.normal(size=(4000, 64))))
    queries, ids = data[::50], np.arange(4000)
    best = nearest._Best(ids[::50], queries, 5)
    for start, stop in ((0, 256), (256, 2000), (2000, 4000)):
        best.add(ids[start:stop], data[start:stop])
    scores = queries @ data.T
    scores[np.arange(len(queries)), ids[::50]] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5]
    assert (best.found == order).all()
    assert best.scored < most * scores.size


def windows_around(word, count):
    """An item of many windows that share a word far longer than the others."""
    random = np.random.default_rng(6)
    return " ".join(" ".join(f"w{x}" for x in random.integers(0, 10**6, 12)) + " " + word for _ in range(count // 13))


def test_rows_of_decontamination_are_hits(spark):
    word = "internationalisation"
    item = windows_around(word, 3000)
    docs = spark.createDataFrame([(i, f"{word} and no more {word}") for i in range(500)] + [(500, item)],
                                 "doc_id long, text string")
    found = decontaminate.windows(spark.createDataFrame([(1, item)], "item_id long, text string"))
    n = found.count()
    assert n == len(item.split()) - 12
    assert decontaminate.spots(docs, found).count() == 501 + n


@pytest.mark.parametrize("bound", [decontaminate.MAX_BROADCAST_BYTES, 0])
def test_equal_hashes_are_no_hits(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_BYTES", bound)
    monkeypatch.setattr(decontaminate, "_key", lambda said: F.pmod(F.xxhash64(said), F.lit(3)))
    said = windows_around("middle", 200)
    docs = spark.createDataFrame([(1, said), (2, said.replace("middle", "centre")), (3, "w1 " * 40), (4, "Short, item"),
                                  (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", said), ("b", said), ("c", "short item")], "item_id string, text string")
    found = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert found == {1: (len(said.split()), 2), 2: (0, 0), 3: (0, 0), 4: (2, 1), 5: (0, 0)}


def test_one_stranger_among_many_linked_nodes_moves_few_rows(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 64)
    linked = spark.range(20_000).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("root"))
    strangers = spark.range(20_000, 20_100).select(F.col("id").alias("node"), F.col("id").alias("root"))
    for others, most in ((strangers.filter("node = 20000"), 20_001), (strangers, 20_100)):
        members = (linked.unionByName(others).withColumn("bucket", F.lit(5).cast("long"))
                   .withColumn("band", F.lit(3)).withColumn("crowd", F.lit(most).cast("long")))
        dealt = near_dup._dealt(near_dup._mixed(members))
        blocks = -(-(most - 20_000) // 32)
        assert dealt.filter("root = 0").count() == 20_000 * blocks
        assert dealt.filter("root != 0").count() == (most - 20_000) * (625 + blocks)


def test_each_pair_of_different_components_meets_in_one_tile(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 8)
    rows = [(i, i // 30 if i < 60 else i, 9, 2, 75) for i in range(75)]
    members = spark.createDataFrame(rows, "node long, root long, bucket long, band int, crowd long")
    tiles = near_dup._dealt(near_dup._mixed(members)).collect()
    met = {}
    for tile in {(t["low"], t["high"]) for t in tiles}:
        inside = [t for t in tiles if (t["low"], t["high"]) == tile]
        left = [t for t in inside if t["side"] == 0]
        right = left if tile[0] == tile[1] else [t for t in inside if t["side"] == 1]
        for a in left:
            for b in right:
                if a["root"] != b["root"] and (tile[0] != tile[1] or a["node"] < b["node"]):
                    pair = (min(a["node"], b["node"]), max(a["node"], b["node"]))
                    met[pair] = met.get(pair, 0) + 1
    root = {r[0]: r[1] for r in rows}
    assert met == {(a, b): 1 for a in root for b in root if a < b and root[a] != root[b]}
