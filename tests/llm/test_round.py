"""Personal data, importance resampling and centroid clustering against plain versions."""

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from posthaste.llm import clustering, importance, personal

# --- personal data -----------------------------------------------------------


def plain_spans(text):
    spans = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(d) for d in m[0] if d.isdigit()]
        total = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            spans.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append((m.start(), m.end(), "phone"))
    return sorted(spans, key=lambda s: (s[0], personal.KINDS.index(s[2])))


def test_base_spans_equal_the_expressions():
    rng = random.Random(3)
    for _ in range(6000):
        text = "".join(rng.choice("a@.1234567890 -+()bé") for _ in range(rng.randint(0, 60)))
        assert personal.detect(text) == plain_spans(text)


@pytest.mark.parametrize("text, kind, shown", [
    ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
    ("john.doe[at]example.com", "email", "john.doe[at]example.com"),
    ("write john at example dot com", "email", "john at example dot com"),
    ("john@example dot com", "email", "john@example dot com"),
    ("x john&#64;example&#46;com", "email", "john&#64;example&#46;com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("a​b@ex​ample.org", "email", "a​b@ex​ample.org"),
    ("call plus one five five five one two three four five six seven!", "phone",
     "plus one five five five one two three four five six seven"),
    ("é four one one one, 1111 1111 one one one one.", "card", "four one one one, 1111 1111 one one one one"),
    ("at one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("call +1 (555) 555‑7713", "phone", "+1 (555) 555‑7713"),
    ("vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "card", None)])
def test_disguised_identifiers_come_back_as_source_spans(text, kind, shown):
    base, spans = personal.find_personal(text)
    assert base == [] and [s[2] for s in spans] == [kind]
    start, end, _ = spans[0]
    assert text[start:end] == (shown or text)
    assert personal.masked(text) == text[:start] + f"<{kind}>" + text[end:]


@pytest.mark.parametrize("text", [
    "look at the dot on it", "we met at google.com", "john @ example.com", "price 3 (at) 5.00", "one two three four",
    "привет мир почта", "see (a) and [b] at home", "The at. Dot com", "point at that dot"])
def test_plain_prose_has_no_identifiers(text):
    assert personal.find_personal(text) == ([], [])


def test_base_spans_stay_beside_added_ones():
    text = "a@b.org, c (at) d (dot) org, 10.0.0.1"
    base, spans = personal.find_personal(text)
    assert [s[2] for s in base] == ["email", "ip"] and set(base) < set(spans)
    assert [text[s:e] for s, e, _ in spans] == ["a@b.org", "c (at) d (dot) org", "10.0.0.1"]


@pytest.mark.parametrize("unit", ["a", "1", "1 ", "(", " ", "a@", " at a", "a dot ", "1.", "+1", "а", "( at", "，a", "one "])
def test_time_grows_with_the_text(unit):
    # A square of the length would take minutes.
    personal.find_personal(unit * (400_000 // len(unit)))


def test_personal_edges(spark):
    rows = [(1, None), (2, ""), (None, "x a@b.cd"), (3, "y " * 50_000 + "a@b.cd"), (3, "y " * 50_000 + "a@b.cd")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id int, text string, spans string")
    found = sorted(personal.scan(docs).collect(), key=str)
    assert len(found) == 5 and {(r["doc_id"], r["spans"]) for r in found} == {
        (1, ""), (2, ""), (None, "email:2:8"), (3, "email:100000:100006")}
    assert {r["base_sha256"] for r in found if r["doc_id"] in (1, 2)} == {hashlib.sha256(b"").hexdigest()}
    assert personal.scan(docs.filter("false")).count() == 0
    hidden = personal.mask(docs).collect()
    assert personal.mask(docs).columns == docs.columns
    assert sorted({str(r["text"])[-7:] for r in hidden}) == sorted({"None", "", "<email>"})


# --- importance ----------------------------------------------------------------

def test_crcs_of_any_length():
    rng = random.Random(1)
    features = [rng.randbytes(n) for n in [*range(1, 40), 255, 256, 257, 511, 512, 513, 5000]] * 2
    assert importance.crc32_of(features).tolist() == [zlib.crc32(f) for f in features]
    assert importance.crc32_of([]).tolist() == []


def plain_features(text, most):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(words), [b" ".join(words[i:i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain_importance(docs, target, most, buckets, seed, percent, least):
    found = [(d, *plain_features(t, most)) for d, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, features in found:
        for f in features:
            s[zlib.crc32(f) % buckets] += 1
    for text in target:
        for f in plain_features(text, most)[1]:
            t[zlib.crc32(f) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, words, features in found:
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in features)
        rows.append((doc_id, words, len(features), weight,
                     weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    count = percent * len(able) // 100
    out = [(d, n, w, sc, place + 1 if place < count else None) for place, (d, _, n, w, sc) in enumerate(able)]
    return sorted(out + [(d, n, w, sc, None) for d, words, n, w, sc in rows if words < least], key=str)


@pytest.mark.parametrize("most, buckets", [(1, 97), (3, 100_000)])
def test_importance_equals_a_plain_version(spark, monkeypatch, most, buckets):
    monkeypatch.setattr(importance, "PIECE_BYTES", 64)
    rng = random.Random(most)
    words = ["Alpha", "beta", "ΓΑΜΜΑ", "d3", "É", "x" * 300, "of"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(40)]
    docs += [(None, "of beta " * 9), (5, None), (6, ""), (7, docs[7][1]), (7, docs[7][1]), (8, "!! ?")]
    target = ["alpha beta of", None, "beta d3"]
    found = importance.importance(
        spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id int, text string, rank int").repartition(3),
        spark.createDataFrame([(t,) for t in target], "text string"), most=most, buckets=buckets, percent=30, least_words=5)
    assert found.dtypes == [(n, "bigint") for n in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, found.collect()), key=str) == plain_importance(docs, target, most, buckets, 2024, 30, 5)


def test_resampled_documents(spark):
    docs = spark.createDataFrame([(i, "target words here" if i % 4 == 0 else "other things there", i) for i in range(80)],
                                 "doc_id long, text string, drawn int")
    target = spark.createDataFrame([("target words here",)] * 50, "text string")
    kept = importance.resampled(docs, target, percent=20, least_words=1)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == 16 and sum(r["doc_id"] % 4 == 0 for r in rows) >= 12
    empty = docs.filter("false")
    assert importance.importance(empty, target).count() == 0
    assert importance.importance(docs.limit(3), empty.select("text")).count() == 3


# --- clustering ------------------------------------------------------------------

def plain_clusters(rows, k, rounds, seed, scale, size):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids)) for _, x in kept]
    for _ in range(rounds):
        places = assigned()
        for n in range(len(centroids)):
            members = [x for (_, x), (_, place) in zip(kept, places) if place == n]
            if members:
                centroids[n] = [sum(column) // len(members) for column in zip(*members)]
    places = assigned()
    return sorted(((i, n, d) for (i, _), (d, n) in zip(kept, places)), key=str), centroids


@pytest.mark.parametrize("spread", [0.2, 1e5])
def test_clusters_equal_a_plain_version(spark, monkeypatch, spread):
    monkeypatch.setattr(clustering, "BLOCK", 16)
    rng = np.random.default_rng(int(spread))
    centres = rng.normal(size=(5, 4)) * spread
    rows = [(i, (centres[i % 5] + rng.normal(size=4)).tolist()) for i in range(150)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, [0.0] * 4), (901, None), (902, [1.0]), (903, [None] * 4),
             (904, [math.nan] * 4), (905, [math.inf, 0.0, 0.0, 0.0]), (906, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    placed, centroids, scanned = clustering.clustered(df, k=7, rounds=6, seed=2, scale=3, size=4)
    expected, plain_centroids = plain_clusters(rows, 7, 6, 2, 3, 4)
    assert sorted(map(tuple, placed.collect()), key=str) == expected
    assert centroids.tolist() == plain_centroids
    # Bounds spare vectors: later assignments scan fewer than all.
    assert scanned[0] == 153 and len(scanned) == 7 and min(scanned) < 153
    totals = clustering.with_totals(placed, centroids).collect()
    assert {r["inertia"] for r in totals} == {sum(d for _, _, d in expected)}
    assert {(r["cluster"], r["cluster_inertia"]) for r in totals} == {
        (c, sum(d for _, n, d in expected if n == c)) for c in {n for _, n, _ in expected}}


def test_heaps_hold_every_vector_in_order():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-50, 50, (200, 3)).astype(np.int32)
    centroids = vectors[:6].astype(np.int64)
    block = clustering._filled(list(range(200)), vectors, centroids)
    offsets = np.zeros(6)
    for _ in range(5):
        moved = centroids + rng.integers(-2, 3, centroids.shape)
        offsets = offsets * (1 + clustering.ROUNDING) + clustering._risen(centroids, moved)
        centroids = moved
        clustering._rescanned(block, centroids, offsets)
        squares = ((vectors[:, None, :].astype(int) - centroids[None]) ** 2).sum(axis=2)
        assert (block.cluster == squares.argmin(axis=1)).all()
        again = next(clustering._read(iter([clustering._row(block, 6, 0)]), 6, 3))
        assert again.heaps == block.heaps
        assert sorted(i for heap in block.heaps for _, i in heap) == list(range(200))
        for heap in block.heaps:
            copy = list(heap)
            heapq.heapify(copy)
            assert [heapq.heappop(copy)[0] for _ in range(len(copy))] == sorted(key for key, _ in heap)


def test_clusters_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, 5.0])], "vec_id long, embedding array<float>")
    placed, centroids, _ = clustering.clustered(df, k=16, rounds=2, scale=64, size=2)
    assert sorted(r["distance"] for r in placed.collect()) == [0, 0] and len(centroids) == 2
    placed, centroids, _ = clustering.clustered(df.filter("false"), k=16, rounds=2, scale=64, size=2)
    assert clustering.with_totals(placed, centroids).count() == 0
    far = df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e30))
    assert clustering.clustered(far, k=2, rounds=1, size=2)[0].count() == 0
