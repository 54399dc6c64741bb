"""Checks that stop a run, and hash manifests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


class IntegrityError(ValueError):
    """A check failed."""


def assert_counts(df: DataFrame, expected: dict[str, tuple[Column, int]]) -> None:
    """All conditions' counts in one pass."""
    got = df.agg(*(F.count_if(c).alias(k) for k, (c, _) in expected.items())).first().asDict()
    wrong = {k: (got[k], n) for k, (_, n) in expected.items() if got[k] != n}
    if wrong:
        raise IntegrityError(f"counts differ (got, expected): {wrong}")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, *keys: str) -> None:
    if bad := duplicate_keys(df, *keys).take(5):
        raise IntegrityError(f"repeated keys: {bad}")


def assert_no_columns(df: DataFrame, forbidden: Iterable[str]) -> None:
    if bad := sorted(set(df.columns) & set(forbidden)):
        raise IntegrityError(f"forbidden columns: {bad}")


def assert_same_rows(a: DataFrame, b: DataFrame) -> None:
    """Equal as bags of rows."""
    if a.exceptAll(b).take(1) or b.exceptAll(a).take(1):
        raise IntegrityError("the tables differ")


def assert_disjoint(groups: DataFrame, key: str) -> None:
    if bad := groups.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").take(5):
        raise IntegrityError(f"keys in several groups: {bad}")


def assert_apart(keep: DataFrame, drop: DataFrame, key: str) -> None:
    """No representative is itself redundant."""
    if bad := keep.select(key).distinct().join(drop.select(key), key, "left_semi").take(5):
        raise IntegrityError(f"kept and dropped: {bad}")


def mandatory(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join in which a missing key stops the query."""
    j = left.join(right.withColumn("_there", F.lit(True)), key, "left")
    return j.where(F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("_there")


#: Bytes that a task holds of a file.
CHUNK = 1 << 20


def opened(path: str):
    """The file system and the place in it of a path as Spark lists it, which isn't quoted as an address is."""
    from pyarrow import fs

    scheme, host, at = re.match(r"(?:([A-Za-z][\w+.-]*):)?(//[^/]*)?(.*)", path, re.S).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), at
    return fs.FileSystem.from_uri(f"{scheme}:{host or '//'}{quote(at)}")


def file_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, bytes, sha256) of files, a chunk of each in memory at a time."""
    for batch in batches:
        size, out = [], []
        for path in batch.column(0).to_pylist():
            system, at = opened(path)
            digest, n = hashlib.sha256(), 0
            with system.open_input_stream(at, buffer_size=0) as f:
                while chunk := f.read(CHUNK):
                    digest.update(chunk)
                    n += len(chunk)
            size.append(n)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(out, pa.string())], names=["path", "bytes", "sha256"])


def _digests(files: DataFrame, tasks: int) -> DataFrame:
    """(path, bytes, sha256): only names are listed, empty files among them, and every file is read by one task."""
    ship(files.sparkSession)
    paths = files.sparkSession.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string")
    return paths.repartition(max(1, tasks), "path").mapInArrow(file_digests, "path string, bytes long, sha256 string")


def hash_manifest(spark: SparkSession, path: str, pattern: str = "*", tasks: int | None = None) -> DataFrame:
    """(file, bytes, sha256) of the files below a folder; ``file`` is the path below it.

    Files of any size: a task streams ``CHUNK`` bytes of one at a time, from any store that Arrow opens (local, HDFS, S3, GCS).
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    got = _digests(files, tasks or spark.sparkContext.defaultParallelism)
    return got.select(F.substring_index("path", root, -1).alias("file"), "bytes", "sha256")


def verify_manifest(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(file, state): match, mismatch, missing or unlisted."""
    j = expected.select("file", F.col("sha256").alias("want")).join(found.select("file", F.col("sha256").alias("got")), "file", "full")
    state = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("got") == F.col("want"), "match").otherwise("mismatch")
    return j.select("file", state.alias("state"))


def assert_no_drift(spark: SparkSession, path: str, sha256: str) -> None:
    got = _digests(spark.read.format("binaryFile").load(path), 1).first()
    if got is None or got.sha256 != sha256:
        raise IntegrityError(f"{path} isn't the pinned input")


def assert_none_of(spark: SparkSession, path: str, pattern: str) -> None:
    """No file below a folder has a name that matches."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    if bad := names.take(5):
        raise IntegrityError(f"forbidden files: {[r.path for r in bad]}")


def latest_decisions(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of an append-only decision log."""
    names = [c for c in log.columns if c not in (key,)]
    return log.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("r")).select(key, "r.*")


def assert_not_final(batch: DataFrame, finals: DataFrame, key: str) -> None:
    if bad := batch.join(finals, key, "left_semi").take(5):
        raise IntegrityError(f"already final: {bad}")
