"""Answers from a plug-in scorer, in resumable chunks."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posthaste import schemas
from posthaste.functions import text
from posthaste.operators import dedupe
from posthaste.operators.rubric import QUESTIONS
from posthaste.sources import tables

Scorer = Callable[[str], dict]

CONCURRENCY = 8
CHUNKS_PER_RUN = 1_000
# Commits of one call, however many chunks there are; at most one is lost with a stopped job.
MAX_RUNS = 32
TRIES = 2
# One prime per question, in rubric order.
OFFLINE_FACTORS = (3, 7, 11, 13, 17, 19, 23, 29, 31, 37)

_STAMPS = [T.StructField("started_at", T.TimestampType()), T.StructField("finished_at", T.TimestampType())]
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


class ScoringError(Exception):
    """Raised by a scorer for a text it could not answer."""


def offline_scorer(content: str) -> dict:
    """Answers by arithmetic on the text's length; for tests and dry runs."""
    n = len(content)
    answers: dict = {"input_tokens": n, "output_tokens": 12}
    for factor, (question, spec) in zip(OFFLINE_FACTORS, QUESTIONS.items()):
        if spec["type"] == "noul":
            answers[question] = (n * factor) % 101 / 100.0
        elif spec["type"] == "score":
            answers[question] = float((n * factor) % 5)
        else:
            answers[question] = list(spec["criteria"])[(n * factor) % 7]
    return answers



def annotate(df: DataFrame, scorer: Scorer, concurrency: int = CONCURRENCY,
             timed: bool = True) -> DataFrame:
    """Add the answer columns. A text that fails twice gets NULL answers.

    Calls within a task overlap, as a remote scorer mostly waits. Store the
    result before using it twice: a second use would call the scorer again.
    """
    fields = [*schemas.ANSWERS.fields, *(_STAMPS if timed else [])]
    schema = T.StructType([*df.schema.fields, *fields])
    # Only plain values go to the workers.
    names = schema.fieldNames()
    answer_types = [(f.name, _ARROW[f.dataType.simpleString()]) for f in schemas.ANSWERS.fields]
    failures = (ScoringError,)

    def attempt(content: str | None) -> tuple:
        begun, answers = dt.datetime.now(dt.timezone.utc), {}
        for _ in range(TRIES if content is not None else 0):
            try:
                answers = scorer(content)
                break
            except failures:
                continue
        return answers, begun, dt.datetime.now(dt.timezone.utc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                results = list(pool.map(attempt, batch.column("text").to_pylist()))
                arrays = [pa.array([r[0].get(name) for r in results], kind)
                          for name, kind in answer_types]
                if timed:
                    stamp = pa.timestamp("us", tz="UTC")
                    arrays += [pa.array([r[k] for r in results], stamp) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names)

    return df.mapInArrow(run, schema)


def pending(chunked: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of chunks that are not done. A done chunk stays done, failed rows and all."""
    return chunked.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")


def annotate_chunks(chunked: DataFrame, out_dir: str, scorer: Scorer,
                    chunks_per_run: int = CHUNKS_PER_RUN, concurrency: int = CONCURRENCY) -> DataFrame:
    """Annotate every chunk that is not stored yet and return the whole table.

    ``chunked`` is a stored table with (ord, text, chunk_id). Each run of
    chunks is committed as one write, so a stopped job loses at most one run
    and the number of files does not grow with the number of chunks. A chunk
    is a bounded number of rows, hence no hot task.
    """
    spark = chunked.sparkSession
    done = tables.read_chunks(spark, out_dir, schemas.ANNOTATED)
    # One look at the stored chunks: their ids, not their rows, tell what is left.
    status = tables.stored(pending(chunked.select("chunk_id").distinct(), done), "pending")
    first, last = status.agg(F.min("chunk_id"), F.max("chunk_id")).first()
    if first is not None:
        step = max(chunks_per_run, -(-(last - first + 1) // MAX_RUNS))
        tasks = min(step, last - first + 1, 4 * spark.sparkContext.defaultParallelism)
        for low in range(first, last + 1, step):
            here = F.col("chunk_id").between(low, low + step - 1)
            part = (chunked.select("ord", "text", "chunk_id").filter(here)
                    .join(status.filter(here), "chunk_id", "left_semi"))
            # An explicit count: adaptive execution must not merge these tasks.
            spread = part.repartition(tasks, "chunk_id").sortWithinPartitions("chunk_id", "ord")
            tables.write_table(annotate(spread, scorer, concurrency),
                               f"{out_dir}/run={uuid.uuid4().hex}")
    return tables.read_chunks(spark, out_dir, schemas.ANNOTATED)


def retry_missing(annotated: DataFrame, scorer: Scorer, redo_dir: str,
                  concurrency: int = CONCURRENCY) -> DataFrame:
    """A further pass over rows without answers, stored and patched in."""
    spark = annotated.sparkSession
    failed = annotated.filter(text.is_missing(F.col("ragebait"))).select("ord", "text")
    spread = failed.repartition(spark.sparkContext.defaultParallelism, "ord")
    redo = annotate(spread, scorer, concurrency)
    tables.write_table(redo, redo_dir)
    stored = spark.read.schema(redo.schema).parquet(redo_dir)
    return dedupe.patch_results(annotated, stored, schemas.ANSWERS.fieldNames())


def done_chunks(spark: SparkSession, out_dir: str) -> DataFrame:
    return tables.read_chunks(spark, out_dir, schemas.ANNOTATED).select("chunk_id").distinct()
