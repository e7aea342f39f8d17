"""Quality scores from document statistics: random Fourier features, ridge scores, isotonic calibration.

Statistics of every whole text are computed once and stored. Random Fourier
features of the scaled statistics approximate a Gaussian kernel; tasks sum
their normal equations, and the sums give the ridge weights. Raw scores of
other labelled rows, counted in bins, give the isotonic calibration.

The model is fitted on a bounded sample of labelled rows, ``MAX_LABELLED`` by
default, chosen by hash; statistics and scores cover every document.

Nulls and ties: a null text counts as empty; an empty text has all statistics
zero and gets a score like any other. Labels that are null, or whose document
is missing, teach nothing; repeated labels count each. Without any label the
score is 0.5. Repeated rows give repeated results, an empty table an empty one;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posthaste.llm.words import as_bytes
from posthaste.sources.tables import stored

MAX_LABELLED = 40_000
FEATURES = 256
BANDWIDTH = 3.0
RIDGE = 1e-3
BINS = 512
# Share of the sample that calibrates and does not fit weights.
CALIBRATED = 4
REJECT_BELOW = 0.3

_CLASS = np.zeros(256, dtype=np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (0 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit()
                  else 4 if _c == " " else 5 if _c in "\n\r" else 6 if _c in ".," else 7 if _c in "!?"
                  else 8 if _c in "#$%&*@^~" else 9 if _c in "|<>{}[]\\/_=+" else 10)
_CLASSES = 11
STATISTICS = (*[f"share_{i}" for i in range(_CLASSES)], "log_bytes", "log_words", "word_bytes", "distinct_words",
              "top_word", "line_words", "distinct_lines", "short_lines", "capital_words", "plain_words",
              "distinct_pairs", "sentence_words")


def statistics(raw: bytes) -> np.ndarray:
    """The statistics of one text; all zero for an empty one."""
    found = np.zeros(len(STATISTICS), dtype=np.float32)
    words = raw.split()
    if not words:
        return found
    counts = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=_CLASSES)
    found[:_CLASSES] = counts / len(raw)
    tally: dict[bytes, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    found[_CLASSES:] = (
        np.log1p(len(raw)), np.log1p(n), sum(map(len, words)) / n, len(tally) / n, max(tally.values()) / n,
        np.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
        sum(len(x) < 40 for x in lines) / max(1, len(lines)),
        sum(w.isupper() for w in words) / n, sum(w.isalpha() or w[0] >= 128 for w in words) / n,
        len(set(zip(words, words[1:]))) / n, np.log1p(n / (1 + counts[6])))
    return found


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.stack([statistics(text) for text in as_bytes(batch.column("text"))]) if batch.num_rows else (
            np.zeros((0, len(STATISTICS)), dtype=np.float32))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel(), pa.float32()), len(STATISTICS))
        yield pa.record_batch([batch.column("doc_id"), flat.cast(pa.list_(pa.float32()))], ["doc_id", "stats"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, stats)``, one row per row."""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(
        _statistics, "doc_id long, stats array<float>")


@dataclass(frozen=True)
class QualityModel:
    """Everything that turns statistics into a calibrated score."""

    center: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.center) / self.spread, -8, 8)
        waves = np.cos(scaled @ self.directions + self.phases) * np.sqrt(2 / FEATURES)
        return np.concatenate([waves, np.ones((len(stats), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.levels)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(
        batch.num_rows, len(STATISTICS)).astype(np.float64)


def _equations(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    """One task's sums: row ``i`` holds products of feature ``i`` with all features and the label."""
    size = FEATURES + 1
    total = np.zeros((size, size + 1))
    for batch in batches:
        seen = model.features(_rows(batch))
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
        total += seen.T @ np.concatenate([seen, label[:, None]], axis=1)
    yield pa.record_batch([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                          ["i", "sums"])


def _scores(batches: Iterator[pa.RecordBatch], model: QualityModel, calibrated: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = model.score(_rows(batch)) if calibrated else model.raw(_rows(batch))
        place = batch.schema.get_field_index("stats")
        yield batch.set_column(place, "score", pa.array(found, pa.float64()))


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values``, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for value, weight in zip(values.tolist(), weights.tolist()):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            value, weight, count = pools.pop()
            last = pools[-1]
            last[0] = (last[0] * last[1] + value * weight) / (last[1] + weight)
            last[1] += weight
            last[2] += count
    return np.concatenate([np.full(int(p[2]), p[0]) for p in pools]) if pools else np.zeros(0)


def labelled_sample(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """At most ``max_labelled`` rows of ``labels(doc_id, quality)`` that may be learned from, chosen by hash,
    whatever the labels of one doc_id."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
             .filter("doc_id is not null and label is not null").filter(~held_out(F.col("doc_id"))))
    share = min(1.0, max_labelled / max(known.count(), 1))
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    drawn = known.withColumn("place", place).filter(F.col("place") < int(share * (1 << 30)))
    return drawn.orderBy("place", "doc_id", "label").limit(max_labelled).drop("place")


def fit(labelled: DataFrame) -> QualityModel:
    """``(doc_id, stats, label)`` -> a model; label 1 is good, 0 is not. Give a bounded sample."""
    random = np.random.default_rng(7)
    directions = random.normal(size=(len(STATISTICS), FEATURES)) / BANDWIDTH
    phases = random.uniform(0, 2 * np.pi, FEATURES)
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(CALIBRATED))
    sample = stored(labelled.withColumn("part", part), "labelled")
    moments = sample.agg(*[f(F.col("stats")[i].cast("double")) for f in (F.avg, F.stddev_pop)
                           for i in range(len(STATISTICS))]).first()
    size = len(STATISTICS)
    center = np.array([v or 0.0 for v in moments[:size]])
    spread = np.array([v if v else 1.0 for v in moments[size:]])
    model = QualityModel(center, spread, directions, phases, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    sums = sample.filter("part != 0").select("stats", "label").mapInArrow(
        partial(_equations, model=model), "i int, sums array<double>")
    # The sums of the tasks meet feature by feature: FEATURES + 1 rows of as many numbers.
    gathered = (sums.select("i", F.posexplode("sums").alias("j", "value")).groupBy("i", "j")
                .agg(F.sum("value").alias("value")).collect())
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for i, j, value in gathered:
        total[i, j] = value
    seen = max(total[-1, -2], 1.0)
    matrix = total[:, :-1] / seen + RIDGE * np.eye(FEATURES + 1)
    weights = np.linalg.solve(matrix, total[:, -1] / seen)
    model = QualityModel(center, spread, directions, phases, weights, np.array([0.0]), np.array([0.5]))
    # Raw scores lie near 0 to 1; bins beyond that are the outermost ones.
    place = F.least(F.greatest(F.floor((F.col("score") + 0.5) / 2 * BINS), F.lit(0)), F.lit(BINS - 1))
    bins = (sample.filter("part = 0").select("stats", "label")
            .mapInArrow(partial(_scores, model=model, calibrated=False), "score double, label int")
            .groupBy(place.alias("bin")).agg(F.avg("label").alias("level"), F.count("*").alias("n"),
                                             F.avg("score").alias("at")).orderBy("bin").collect())
    if not bins:
        return model
    levels = isotonic(np.array([b["level"] for b in bins]), np.array([b["n"] for b in bins], dtype=float))
    return QualityModel(center, spread, directions, phases, weights, np.array([b["at"] for b in bins]),
                        np.clip(levels, 0.0, 1.0))


def scored(stats: DataFrame, model: QualityModel) -> DataFrame:
    """``(doc_id, stats)`` -> ``(doc_id, score)``."""
    return stats.select("doc_id", "stats").mapInArrow(
        partial(_scores, model=model, calibrated=True), "doc_id long, score double")


def held_out(key: Column, parts: int = 5, part: int = 0) -> Column:
    """Rows whose id's CRC-32 leaves ``part``; a null id is not among them."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % parts == part, F.lit(False))


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of all documents, taught by labels that are not held out."""
    stats = stored(document_statistics(docs), "stats")
    # The sample is bounded, so it can go to every task.
    model = fit(stats.join(F.broadcast(labelled_sample(labels)), "doc_id"))
    return scored(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                       (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))


def _keep(batches: Iterator[pa.RecordBatch], model: QualityModel, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            # A task sees whole texts, one Arrow batch at a time.
            stats = np.stack([statistics(text) for text in as_bytes(batch.column("text"))]).astype(np.float64)
            yield batch.filter(pa.array(model.score(stats) >= least))


def without_rejected(docs: DataFrame, labels: DataFrame, least: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``least``, with all their columns."""
    sample = F.broadcast(stored(labelled_sample(labels), "sample"))
    taught = document_statistics(docs.select("doc_id", "text").join(sample, "doc_id", "left_semi"))
    model = fit(taught.join(sample, "doc_id"))
    return docs.mapInArrow(partial(_keep, model=model, least=least), docs.schema)
