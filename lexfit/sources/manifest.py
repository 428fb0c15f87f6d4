"""Outputs that are written in attempts and read by what was committed.

Each attempt has a folder of its own. When all its files are there, a manifest that lists
them with their lengths is put beside it, as one file, which is the commit. Readers go by
manifests, so what a failed or repeated attempt has left is never read, and a part that is
committed is not written again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def is_committed(spark: SparkSession, path: str, number: int) -> bool:
    return _exists(spark, f"{path}/manifest/number={number}/_SUCCESS")


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Path and length of the data files below; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return found.select("path", "length")


def write_committed(spark: SparkSession, path: str, write: Callable[[str], None], number: int = 0) -> bool:
    """Runs ``write(folder)`` for an attempt at the part ``number`` and commits it; False if it is committed already."""
    if is_committed(spark, path, number):
        return False
    attempt = f"{path}/attempts/number={number}-{uuid.uuid4().hex}"
    write(attempt)
    files = _files(spark, attempt)
    files.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/number={number}")  # a row per file
    return True


def committed_files(spark: SparkSession, path: str, numbers: list[int]) -> list[str]:
    """Paths of the files of the given parts, all of which must be committed and of their length."""
    missing = [n for n in numbers if not is_committed(spark, path, n)]
    if missing:
        raise FileNotFoundError(f"parts {missing} of {path} are not committed")
    if not numbers:
        return []
    listed = spark.read.schema("path string, length long").json([f"{path}/manifest/number={n}" for n in numbers])
    paths = [r.path for r in listed.select("path").collect()]  # a row per file, as any reader of files holds them
    if paths:
        changed = listed.join(_files(spark, paths).withColumnRenamed("length", "_now"), "path", "left").where(F.col("_now").isNull() | (F.col("_now") != F.col("length")))
        if not changed.isEmpty():
            raise OSError(f"files of {path} are not as they were committed")
    return paths
