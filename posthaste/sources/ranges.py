"""Which files of a growing table can hold a key, so that a look-up reads only those.

Beside a table ``path`` lies ``path.ranges`` with one row per data file: the
smallest and largest key, rows without key and the next free order number. It
is only a hint that excludes files: a file without a row there, as after a
crash between the two writes, is always read, and gets its row with the next
append. The rows are published whole, as one file, so they are read as one. Keys that grow with time, as post ids do, keep the files of a look-up
few however long the table grows; keys without order cost what a scan costs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posthaste.sources import tables

# Ranges of keys that a batch is described by: a stray old key costs the files of its range alone.
BATCH_RANGES = 32
_RANGE = "file string, low string, high string, missing boolean, next long"


def index_path(path: str) -> str:
    return f"{path.rstrip('/')}.ranges"


def _known(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_published(spark, index_path(path), T.StructType.fromDDL(_RANGE))


def _files(spark: SparkSession, path: str) -> list[str]:
    return [f for f in tables.matching_paths(spark, f"{path.rstrip('/')}/*.parquet")]


def _name(file: str) -> str:
    return file.rsplit("/", 1)[1]


def describe_new(spark: SparkSession, path: str, schema: T.StructType, key: str, order: str) -> None:
    """Add rows for the data files that have none; only their key and order columns are read."""
    known = _known(spark, path)
    done = {r["file"] for r in known.select("file").collect()}
    fresh = [f for f in _files(spark, path) if _name(f) not in done]
    if not fresh:
        return
    rows = spark.read.schema(schema).parquet(*fresh)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    found = (rows.select(name.alias("file"), F.col(key).alias("key"), F.col(order).alias("at")).groupBy("file")
             .agg(F.min("key").alias("low"), F.max("key").alias("high"),
                  F.bool_or(F.col("key").isNull()).alias("missing"), (F.max("at") + 1).alias("next")))
    version = tables.publish(known.unionByName(found).coalesce(1), index_path(path))
    # A reader of the version before may still be at work.
    tables.remove(spark, f"{index_path(path)}/version={version - 2}")


def _batch_ranges(batch: DataFrame, key: str) -> tuple[list[tuple[str, str]], bool]:
    """Disjoint increasing ranges that hold all keys of a batch, and whether some row has none."""
    part = F.spark_partition_id().alias("part")
    found = (batch.select(F.col(key).alias("key")).repartitionByRange(BATCH_RANGES, "key").select("key", part)
             .groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"),
                                  F.bool_or(F.col("key").isNull()).alias("missing")).collect())
    return sorted((r["low"], r["high"]) for r in found if r["low"] is not None), any(r["missing"] for r in found)


def _meets(ranges: Sequence[tuple[str, str]], low: str | None, high: str | None) -> bool:
    """Whether one of the ranges has keys in common with [low, high]."""
    if low is None:
        return False
    place = bisect_left([last for _, last in ranges], low)
    return place < len(ranges) and ranges[place][0] <= high


def possible_files(batch: DataFrame, path: str, key: str) -> list[str]:
    """The data files that may hold a key of the batch."""
    spark = batch.sparkSession
    ranges, missing = _batch_ranges(batch, key)
    known = {r["file"]: r for r in _known(spark, path).collect()}
    wanted = []
    for file in _files(spark, path):
        row = known.get(_name(file))
        if row is None or _meets(ranges, row["low"], row["high"]) or (missing and row["missing"]):
            wanted.append(file)
    return wanted


def possible_rows(batch: DataFrame, path: str, schema: T.StructType, key: str) -> DataFrame:
    """The stored rows of these files."""
    files = possible_files(batch, path, key)
    spark = batch.sparkSession
    return tables.zoned(spark.read.schema(schema).parquet(*files)) if files else spark.createDataFrame([], schema)


def next_order(spark: SparkSession, path: str, schema: T.StructType, key: str, order: str) -> int:
    """One above the largest order number stored, 0 for an empty table."""
    describe_new(spark, path, schema, key, order)
    return _known(spark, path).agg(F.coalesce(F.max("next"), F.lit(0))).first()[0]
