"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased (A-Z) and read as words with a blank at either end; its
subwords are all runs of 3 and 4 bytes within. The embeddings of their hashes
are averaged, and a linear softmax over the languages follows. Embeddings and
softmax are trained by stochastic gradient descent in numpy on a bounded sample
of labelled rows, ``MAX_LABELLED`` by default, chosen by hash, in whole texts.

For prediction embeddings and softmax are multiplied out, so every subword adds
one number per language. A temperature, fitted on rows that were not trained
on, calibrates the probabilities; below the one that ``REJECTED`` of those rows
fall short of, a prediction counts as rejected.

Nulls and ties: a text that is null or has no letter is ``und`` with score 0;
so is every text if nothing was learned. Equal probabilities go to the language
that sorts first. Rows with null lang teach nothing. Repeated rows give repeated
results, an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posthaste.llm.words import as_bytes, by_bytes

MAX_LABELLED = 4_000
BUCKETS = 1 << 16
WIDTH = 16
EPOCHS = 8
BATCH = 32
RATE = 0.5
REJECTED = 0.01
SIZES = (3, 4)

_FOLD = np.zeros(256, dtype=np.uint32)
for _b in range(256):
    # Letters and bytes beyond ASCII stay; anything else is a blank.
    _FOLD[_b] = _b + 32 if 65 <= _b <= 90 else _b if _b >= 128 or 97 <= _b <= 122 else 32


def subwords(texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: hashed subwords of all texts in order, and the text each belongs to."""
    blob = _FOLD[np.frombuffer(b" " + b"  ".join(texts) + b" ", dtype=np.uint8)]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    solid = blob != 32
    for size in SIZES:
        count = max(0, len(blob) - size + 1)
        # No blank but at the ends, so no subword reaches into the next text.
        inner = np.ones(count, dtype=bool)
        for k in range(1, size - 1):
            inner &= solid[k:k + count]
        at = np.flatnonzero(inner)
        key = np.full(len(at), size, dtype=np.uint32)
        for k in range(size):
            key = (key ^ blob[at + k]) * np.uint32(16777619)
        yield (key ^ (key >> np.uint32(15))) % np.uint32(BUCKETS), owner[at]


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    # What each subword adds to each language, and what every text starts from.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def probabilities(self, texts: Sequence[bytes]) -> np.ndarray:
        sums = np.zeros((len(self.languages), len(texts)))
        counts = np.zeros(len(texts))
        for keys, owners in subwords(texts):
            counts += np.bincount(owners, minlength=len(texts))
            for total, adds in zip(sums, self.table):
                total += np.bincount(owners, weights=adds[keys], minlength=len(texts))
        return softmax(((sums / np.maximum(counts, 1)).T + self.bias) / self.temperature)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The subwords of each text and their shares: bounded by ``BUCKETS``, however long the text."""
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for piece in by_bytes(texts):
            found = [np.bincount(np.concatenate([k[o == i] for k, o in parts]), minlength=BUCKETS)
                     for parts in [list(subwords(texts[piece]))] for i in range(piece.stop - piece.start)]
            keys = [np.flatnonzero(f) for f in found]
            yield pa.record_batch(
                [batch.column("place").slice(piece.start, len(keys)), batch.column("lang").slice(piece.start, len(keys)),
                 pa.array([k.astype(np.int32) for k in keys], pa.list_(pa.int32())),
                 pa.array([(f[k] / max(1, f.sum())).astype(np.float32) for f, k in zip(found, keys)],
                          pa.list_(pa.float32()))], ["place", "lang", "keys", "shares"])


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str]) -> LanguageModel | None:
    """Embeddings and softmax by stochastic gradient descent, then temperature and rejection.

    ``bags`` holds the subwords of each text and their shares of it.
    """
    if not bags:
        return None
    languages = tuple(sorted(set(labels)))
    random = np.random.default_rng(13)
    target = np.array([languages.index(x) for x in labels])
    order = random.permutation(len(bags))
    held = len(bags) // 5 if len(bags) >= 10 else 0
    aside, taught = order[:held], order[held:]
    vectors = random.normal(scale=0.1, size=(BUCKETS, WIDTH))
    weights, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        random.shuffle(taught)
        for i in taught:
            keys, shares = bags[i]
            hidden = shares @ vectors[keys]
            error = softmax((hidden @ weights + bias)[None, :])[0]
            error[target[i]] -= 1
            # An average moves little with each of its parts, so these take longer steps.
            step = rate * len(keys) ** 0.5 * shares[:, None] * (weights @ error)
            weights -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            vectors[keys] -= step
    table = np.ascontiguousarray((vectors @ weights).T, dtype=np.float32)
    if not held:
        return LanguageModel(languages, table, bias)
    logits = np.stack([table[:, bags[i][0]] @ bags[i][1] for i in aside]) + bias
    losses = {}
    for temperature in np.geomspace(0.02, 20, 61).tolist():
        sure = softmax(logits / temperature)[np.arange(held), target[aside]]
        losses[temperature] = -np.log(np.maximum(sure, 1e-12)).mean()
    best = min(losses, key=losses.get)
    least = float(np.quantile(softmax(logits / best).max(axis=1), REJECTED))
    return LanguageModel(languages, table, bias, best, least)


def fit(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> LanguageModel | None:
    """``docs(doc_id, text, lang)`` -> a model of at most ``max_labelled`` rows, chosen by hash; None without any.

    The hash is of id and text, so rows without an id differ too; of rows that
    are equal in all three only as many come to the driver as the bound leaves.
    """
    known = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    rows = known.count()
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30))
    share = min(1.0, max_labelled / max(rows, 1))
    sample = known.withColumn("place", place).filter(F.col("place") < int(share * (1 << 30)))
    bags = (sample.select("place", "lang", "text")
            .mapInArrow(_bags, "place long, lang string, keys array<int>, shares array<float>")
            .orderBy("place", "lang").limit(max_labelled).toArrow()
            .sort_by([("place", "ascending"), ("lang", "ascending")]))
    held = [(np.asarray(k), np.asarray(v)) for k, v in zip(
        bags.column("keys").to_numpy(), bags.column("shares").to_numpy())]
    return train(held, bags.column("lang").to_pylist())


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    learned = model.value
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        lang: list[str] = []
        score: list[float] = []
        for piece in by_bytes(texts):
            if learned is None:
                lang += ["und"] * (piece.stop - piece.start)
                score += [0.0] * (piece.stop - piece.start)
                continue
            chances = learned.probabilities(texts[piece])
            lang += [learned.languages[i] for i in chances.argmax(axis=1)]
            score += chances.max(axis=1).tolist()
        spoken = batch.column("spoken").to_pylist()
        least = learned.least if learned else 0.0
        yield pa.record_batch(
            [batch.column("doc_id"),
             pa.array([x if s else "und" for x, s in zip(lang, spoken)], pa.string()),
             pa.array([min(1.0, x) if s else 0.0 for x, s in zip(score, spoken)], pa.float64()),
             pa.array([bool(s) and x < least for x, s in zip(score, spoken)])],
            ["doc_id", "lang_pred", "score", "rejected"])


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, lang_pred, score, rejected)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spoken = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", spoken.alias("spoken")).mapInArrow(
        partial(_predict, model=shared), "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    """Rows whose id's CRC-32 leaves ``part``; a null id is not among them."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % parts == part, F.lit(False))


def predict_held_out(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` of all documents, taught by rows that are not held out."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    found = predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
