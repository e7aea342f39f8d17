"""Reading and writing tables."""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posthaste.session import require_utc, work_dir


def _filesystem(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _filesystem(spark, path)
    return fs.exists(jpath)


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    fs, jpath = _filesystem(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(jpath) or [])


def zoned(df: DataFrame) -> DataFrame:
    """Timestamps without a zone become UTC instants, as watermarks need."""
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    if plain:
        require_utc(df.sparkSession)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def read_posts(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A parquet table; with a schema, files that lack a column give NULLs."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return zoned(reader.parquet(path))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV for a path that ends in ``.csv``, parquet for any other."""
    if path.endswith(".csv"):
        # Post text holds line breaks and quotes.
        return (spark.read.schema(schema).option("header", True)
                .option("multiLine", True).option("escape", '"').csv(path))
    return read_posts(spark, path, schema)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_posts(spark, path, schema)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back, so
    later scans neither repeat the work nor depend on its lineage."""
    path = work_dir(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table."""
    fs, jpath = _filesystem(spark, path)
    fs.delete(jpath, True)


def published_versions(spark: SparkSession, table_dir: str) -> list[int]:
    """Committed versions; Spark writes ``_SUCCESS`` when a job has committed."""
    done = matching_paths(spark, f"{table_dir}/version=*/_SUCCESS")
    return sorted(int(p.split("version=")[1].split("/")[0]) for p in done)


class Conflict(Exception):
    """Another writer took the version."""


def _claimed(spark: SparkSession, path: str) -> bool:
    """Make an empty file unless there is one; of several writers one gets True.

    Hadoop's local file system looks first and writes then, so a local file is
    made by the operating system.
    """
    fs, jpath = _filesystem(spark, path)
    fs.mkdirs(jpath.getParent())
    if fs.getScheme() == "file":
        try:
            os.close(os.open(jpath.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    try:
        fs.create(jpath, False).close()
    except Py4JJavaError:
        if not fs.exists(jpath):
            raise
        return False
    return True


def publish(df: DataFrame, table_dir: str, after: int | None = None) -> int:
    """Replace a table in one step, also by a frame that was read from it.

    Readers see the newest committed version; a failed write leaves the old one.
    A writer takes its number by making a file that nobody else can make, so
    writers at the same time get a version each. A frame that was made from
    version ``after`` (0 for an empty table) becomes the next one or raises
    :class:`Conflict`, so nobody's rows are replaced unread; a writer that died
    in between is passed by a call without ``after``. The file system must make
    new files atomically, as HDFS does.
    """
    spark = df.sparkSession
    taken = [int(p.rsplit("version=", 1)[1]) for p in matching_paths(spark, f"{table_dir}/version=*")]
    if after is not None and after != max(published_versions(spark, table_dir), default=0):
        raise Conflict(f"{table_dir}: version {after} is not the newest")
    version = max(taken, default=0) + 1
    while not _claimed(spark, f"{table_dir}/claims/{version}"):
        if after is not None:
            raise Conflict(f"{table_dir}: another writer took version {version}")
        version += 1
    write_table(df, f"{table_dir}/version={version}")
    return version


def read_published(spark: SparkSession, table_dir: str, schema: T.StructType) -> DataFrame:
    versions = published_versions(spark, table_dir)
    if not versions:
        return spark.createDataFrame([], schema)
    return read_posts(spark, f"{table_dir}/version={versions[-1]}", schema)


def committed_runs(spark: SparkSession, directory: str) -> list[str]:
    return [p.rsplit("/", 1)[0] for p in matching_paths(spark, f"{directory}/run=*/_SUCCESS")]


def read_chunks(spark: SparkSession, directory: str, schema: T.StructType) -> DataFrame:
    """All committed result files below a directory, stacked."""
    runs = committed_runs(spark, directory)
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*runs)


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`stored`, with the path, for a caller that removes the table."""
    path = work_dir(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def append_new(new: DataFrame, table_dir: str) -> None:
    """Add rows to a table without rewriting it; an empty frame writes nothing."""
    if not new.isEmpty():
        write_table(new, table_dir, "append")

