"""Trained operators beside plain versions, and what they may learn from."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from posthaste.llm import language, quality


def test_quality_weights_solve_the_ridge_equations(spark):
    rng = np.random.default_rng(5)
    size = len(quality.STATISTICS)
    stats = rng.normal(2, 3, (600, size)).astype(np.float32)
    label = (stats[:, 0] + rng.normal(size=600) > 2).astype(int)
    rows = spark.createDataFrame([(i, s.tolist(), int(y)) for i, (s, y) in enumerate(zip(stats, label))],
                                 "doc_id long, stats array<float>, label int").repartition(5)
    model = quality.fit(rows)
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(quality.CALIBRATED))
    taught = sorted(r["doc_id"] for r in rows.filter(part != 0).collect())
    x = stats.astype(float)
    scaled = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    waves = [[math.sqrt(2 / quality.FEATURES) * math.cos(row @ model.directions[:, k] + model.phases[k])
              for k in range(quality.FEATURES)] + [1.0] for row in scaled[taught]]
    # Least squares of the rows and, beneath them, of the penalty.
    n = len(taught)
    above, below = np.array(waves) / n ** 0.5, quality.RIDGE ** 0.5 * np.eye(quality.FEATURES + 1)
    want = np.linalg.lstsq(np.vstack([above, below]), np.concatenate(
        [label[taught] / n ** 0.5, np.zeros(quality.FEATURES + 1)]), rcond=None)[0]
    assert np.allclose(np.array(waves) @ model.weights, np.array(waves) @ want, atol=1e-5)
    assert (np.diff(model.levels) >= 0).all()
    found = {r["doc_id"]: r["score"] for r in quality.scored(rows, model).collect()}
    raw = np.array([[math.sqrt(2 / quality.FEATURES) * math.cos(v) for v in row @ model.directions + model.phases] + [1.0]
                    for row in scaled]) @ model.weights
    for i in range(600):
        assert found[i] == pytest.approx(np.interp(raw[i], model.edges, model.levels), abs=1e-6)


def plain_subwords(text):
    """The subwords of 3 and 4 bytes of every word with a blank on either side, hashed."""
    folded = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text)
    found = []
    for size in language.SIZES:
        padded = b" " + folded + b" "
        for at in range(len(padded) - size + 1):
            part = padded[at:at + size]
            if 32 not in part[1:-1]:
                key = size
                for b in part:
                    key = ((key ^ b) * 16777619) % 2 ** 32
                found.append((key ^ (key >> 15)) % language.BUCKETS)
    return found


def test_language_chances_are_a_softmax_of_averages():
    rng = np.random.default_rng(2)
    texts = ["Guten Tag, wie geht's?".encode(), b"", b"a", "été à l'œuvre".encode(), b"x1y2 " * 50]
    model = language.LanguageModel(("a", "b", "c"), rng.normal(size=(3, language.BUCKETS)), rng.normal(size=3), 0.7)
    found = model.probabilities(texts)
    by_text = [[] for _ in texts]
    for keys, owners in language.subwords(texts):
        for key, owner in zip(keys.tolist(), owners.tolist()):
            by_text[owner].append(key)
    for text, keys, chances in zip(texts, by_text, found):
        assert sorted(keys) == sorted(plain_subwords(text))
        mean = sum((model.table[:, k] for k in keys), np.zeros(3)) / max(1, len(keys))
        powers = [math.exp(v / 0.7) for v in mean + model.bias]
        assert chances == pytest.approx([p / sum(powers) for p in powers])


def test_samples_to_learn_from_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda bags, labels: seen.append((len(bags), labels)))
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("en").alias("lang"),
                                      F.concat(F.lit("text "), (F.col("id") % 20).cast("string")).alias("text"))
    for rows in (docs, docs.withColumn("doc_id", F.lit(7)), docs.repartition(3)):
        for bound in (4_000, 10):
            language.fit(rows, bound)
    assert all(n <= bound for (n, _), bound in zip(seen, [4_000, 10] * 3))
    assert seen[0][0] > 0 and seen[0] == seen[4]
    labels = spark.range(1_000).select((F.lit(1) + F.col("id") % 3).alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.labelled_sample(labels, 50).count() <= 50
    assert 0 < quality.labelled_sample(labels, 5_000).count() <= 1_000
