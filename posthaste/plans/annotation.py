"""From cleaned posts to the annotated table and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posthaste import schemas
from posthaste.operators import annotate, reports, splits
from posthaste.sources import tables


def run(cleaned: DataFrame, place: str, scorer: annotate.Scorer, size: int = splits.CHUNK_ROWS,
        chunks_per_run: int = annotate.CHUNKS_PER_RUN, only: Column | None = None) -> dict[str, DataFrame]:
    """Chunk, annotate what is not stored yet, and report.

    ``cleaned`` has (ord, text). Chunks are laid down once below ``place``, so a
    job that was stopped goes on with the same ones; ``only`` restricts a call
    to some chunks. Returns the table so far and one row of totals.
    """
    spark = cleaned.sparkSession
    chunks = f"{place}/chunks"
    if not tables.path_exists(spark, f"{chunks}/_SUCCESS"):
        tables.write_table(splits.assign_chunks(cleaned.select("ord", "text"), size), chunks, "overwrite")
    schema = schemas.T.StructType([*schemas.CLEANED.fields, schemas.T.StructField("chunk_id", schemas.LONG)])
    chunked = spark.read.schema(schema).parquet(chunks)
    todo = chunked if only is None else chunked.filter(only)
    done = annotate.annotate_chunks(todo, f"{place}/answers", scorer, chunks_per_run)
    counted = done.agg(F.count_distinct("chunk_id").alias("chunks"))
    # One row beside one row.
    report = reports.cost_report(done).join(F.broadcast(counted))
    return {"annotated": done, "report": report}
