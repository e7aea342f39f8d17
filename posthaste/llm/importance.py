"""Importance resampling towards a target distribution: hashed word runs, log ratios, Gumbel noise.

A feature is a run of 1 to ``most`` consecutive words, repeats counted; its
bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``. The distinct
features of a stretch of text are grouped by their length in bytes, each group
a matrix with a row per feature, and the CRCs of all rows advance by a column
at a time; buckets are then scattered back to where the features stand. A long
feature is cut to rows of ``ROW_BYTES``, whose CRCs are joined afterwards.

A bucket's gain is the logarithm of its share of the target over its share of
the corpus. A document weighs the sum of the gains of its features, and those
with the highest weight plus Gumbel noise are drawn: a sample without
replacement whose chances are the importance weights. The noise is a hash of
the doc_id, so reruns draw the same documents.

Texts are read once, into a table of two bytes a feature. The driver and every
task see ``buckets`` counts, never documents.

A null or empty text has no features and weighs 0; null doc_ids come last among
equal scores. Repeated rows count as often as they occur; rows that share a
doc_id share its noise. An empty corpus gives an empty result, an empty target
a gain by the corpus alone. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posthaste.llm.columns import by_name, by_place
from posthaste.llm.words import PIECE_BYTES, as_bytes, by_bytes
from posthaste.operators import ranks
from posthaste.sources.tables import stored

# Fixed value: the reversed CRC-32 polynomial.
POLYNOMIAL = 0xEDB88320
ONES = 0xFFFFFFFF
# Features above this length are cut to rows of it.
ROW_BYTES = 256
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def _byte_table() -> np.ndarray:
    """What eight shifts make of each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


_TABLE = _byte_table()


def _advance(register: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The CRC registers of all rows after all columns."""
    for column in np.ascontiguousarray(matrix.T):
        register = _TABLE[(register ^ column) & 0xFF] ^ (register >> 8)
    return register


def _skip_table() -> np.ndarray:
    """For each byte of a register, what ``ROW_BYTES`` zero bytes make of it."""
    registers = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None])
    return _advance(registers.ravel(), np.zeros((1024, ROW_BYTES), dtype=np.uint8)).reshape(4, 256)


_SKIP = _skip_table().tolist()


def _long_crcs(features: list[bytes]) -> list[int]:
    """CRCs of long features, the rows of all of them in one matrix.

    All ones to begin with are the same as the first four bytes inverted, and
    a register of zero does not see the zero bytes that fill the first row.
    """
    padded, rows = [], []
    for feature in features:
        head = bytes(b ^ 0xFF for b in feature[:4])
        fill = -len(feature) % ROW_BYTES
        padded += [bytes(fill), head, feature[4:]]
        rows.append((len(feature) + fill) // ROW_BYTES)
    matrix = np.frombuffer(b"".join(padded), dtype=np.uint8).reshape(-1, ROW_BYTES)
    parts = iter(_advance(np.zeros(len(matrix), dtype=np.uint32), matrix).tolist())
    crcs = []
    for count in rows:
        register = 0
        for _ in range(count):
            register = (_SKIP[0][register & 0xFF] ^ _SKIP[1][register >> 8 & 0xFF]
                        ^ _SKIP[2][register >> 16 & 0xFF] ^ _SKIP[3][register >> 24] ^ next(parts))
        crcs.append(register ^ ONES)
    return crcs


def crc32_of(features: list[bytes]) -> np.ndarray:
    """The CRC-32 of each of some byte strings."""
    lengths = np.fromiter(map(len, features), dtype=np.int64, count=len(features))
    crcs = np.zeros(len(features), dtype=np.uint32)
    order = np.argsort(lengths, kind="stable")
    long = order[np.searchsorted(lengths[order], ROW_BYTES, "right"):]
    order = order[:len(order) - len(long)]
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for places in np.split(order, edges):
        if len(places):
            matrix = np.frombuffer(b"".join([features[i] for i in places.tolist()]), dtype=np.uint8)
            register = np.full(len(places), ONES, dtype=np.uint32)
            crcs[places] = _advance(register, matrix.reshape(len(places), -1)) ^ np.uint32(ONES)
    if len(long):
        crcs[long] = _long_crcs([features[i] for i in long.tolist()])
    return crcs


def _pieces(text: bytes) -> Iterator[bytes]:
    """Stretches of about ``PIECE_BYTES`` of a lower-case text, cut between words only."""
    start = 0
    while start < len(text):
        found = _GAP.search(text, start + PIECE_BYTES) if start + PIECE_BYTES < len(text) else None
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def _runs(words: list[bytes], before: list[bytes], most: int) -> list[bytes]:
    """Runs of up to ``most`` words that end in ``words``; ``before`` are the words in front."""
    runs = list(words)
    for length in range(2, most + 1):
        line = before[max(0, len(before) - length + 1):] + words
        runs += [b" ".join(line[i:i + length]) for i in range(len(line) - length + 1)]
    return runs


def _features(text: bytes, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """Number of words and the features of each stretch of a text."""
    before: list[bytes] = []
    for piece in _pieces(text.lower()):
        words = _WORD.findall(piece)
        yield len(words), _runs(words, before, most)
        before = (before + words)[-(most - 1):] if most > 1 else []


def feature_buckets(texts: list[bytes], most: int, buckets: int) -> list[tuple[int, np.ndarray]]:
    """For each text the number of words and the buckets of all features, repeats included."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    counts = [0] * len(texts)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    known: dict[bytes, int] = {}
    held: list[tuple[int, list[int]]] = []
    size = 0

    def scatter() -> None:
        places = (crc32_of(list(known)) % np.uint32(buckets)).astype(kind)
        for line, index in held:
            found[line].append(places[index])
        known.clear()
        held.clear()

    for line, text in enumerate(texts):
        for words, features in _features(text, most):
            counts[line] += words
            held.append((line, [known.setdefault(f, len(known)) for f in features]))
            size += sum(map(len, features)) if most > 1 else min(len(text), 2 * PIECE_BYTES)
            if size > PIECE_BYTES:
                scatter()
                size = 0
    scatter()
    return [(n, np.concatenate(parts) if parts else np.zeros(0, dtype=kind)) for n, parts in zip(counts, found)]


def _profile(batches: Iterator[pa.RecordBatch], most: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for piece in by_bytes(texts, 4 * PIECE_BYTES):
            rows = feature_buckets(texts[piece], most, buckets)
            yield pa.record_batch([
                batch.column("doc_id").slice(piece.start, len(rows)),
                pa.array([n for n, _ in rows], pa.int64()),
                pa.array([len(b) for _, b in rows], pa.int64()),
                pa.array([b.tobytes() for _, b in rows], pa.binary())],
                ["doc_id", "n_words", "n_features", "buckets"])


def _array(value: bytes, buckets: int) -> np.ndarray:
    return np.frombuffer(value, dtype=np.uint16 if buckets <= 1 << 16 else np.uint32)


def _totals(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """How often each bucket occurs in a task."""
    totals = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for value in batch.column("buckets").to_pylist():
            totals += np.bincount(_array(value, buckets), minlength=buckets)
    used = np.flatnonzero(totals)
    yield pa.record_batch([pa.array(used, pa.int64()), pa.array(totals[used], pa.int64())], ["bucket", "n"])


def _weigh(batches: Iterator[pa.RecordBatch], gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        weights = [int(gains[_array(v, len(gains))].sum()) for v in batch.column("buckets").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"),
                               pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])


def profile(texts: DataFrame, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """Words, features and the bucket of every feature of each text, as a written table."""
    placed, [doc_id, text] = by_place(texts, "doc_id", "text")
    rows = placed.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(partial(_profile, most=most, buckets=buckets),
                                  "doc_id long, n_words long, n_features long, buckets binary"), "features")


def bucket_counts(profiled: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Features per bucket over all texts; ``buckets`` numbers reach the driver."""
    parts = profiled.select("buckets").mapInArrow(partial(_totals, buckets=buckets), "bucket long, n long")
    counts = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    most, least = float(corpus.sum() + len(corpus)), float(target.sum() + len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1.0) * most / ((s + 1.0) * least)))
                     for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def noise(seed: int):
    """Thousandths of Gumbel noise from the first 32 bits of sha256(``seed:doc_id``), rounded down."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform)))


def importance(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, seed: int = 2024,
               percent: int = 10, least_words: int = 20) -> DataFrame:
    """``docs(doc_id, text)`` and ``target(text)`` -> ``(doc_id, n_features, weight, score, rank)``, one row per row.

    ``rank`` counts the drawn documents from the highest score on, ties to the
    smaller doc_id; it is null for the others. Of the documents with at least
    ``least_words`` words, ``percent`` hundredths are drawn, rounded down.
    """
    found = profile(docs, most, buckets)
    aims, [text] = by_place(target, "text")
    wanted = profile(aims.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text")), most, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    weighed = found.mapInArrow(partial(_weigh, gains=gain), "doc_id long, n_words long, n_features long, weight long")
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(seed)), "scored")
    able = F.col("n_words") >= least_words
    wanted_rows = scored.filter(able).count() * percent // 100
    rows = scored.select("doc_id", "n_features", "weight", "score", (-F.col("score")).alias("_low"), able.alias("_able"))
    # Every column is part of the order, so only equal rows can change places.
    placed, _ = ranks.with_position(rows.filter("_able"), ["_low", "doc_id", "n_features", "weight"], "_place")
    rank = F.when(F.col("_place") < wanted_rows, F.col("_place") + 1)
    return (placed.withColumn("rank", rank).drop("_place")
            .unionByName(rows.filter("not _able").withColumn("rank", F.lit(None).cast("long")))
            .select("doc_id", "n_features", "weight", "score", "rank"))


def resampled(docs: DataFrame, target: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; rows that share a doc_id go together."""
    placed, [doc_id] = by_place(docs, "doc_id")
    drawn = importance(docs, target, **params).filter("rank is not null").select(F.col("doc_id").alias("drawn")).distinct()
    kept = placed.join(drawn, F.col(doc_id).cast("long").eqNullSafe(F.col("drawn")), "left_semi")
    return by_name(kept, docs.columns, [])
