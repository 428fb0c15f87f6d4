"""Reading landed tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexfit.schemas import PAGE


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table ``<folder>/<name>.parquet`` (file or folder)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def page_scan(spark: SparkSession, folder: str, name: str = "pages") -> DataFrame:
    """Landed HTML pages under the explicit page layout."""
    return spark.read.schema(PAGE).parquet(f"{folder}/{name}.parquet")


def term_table(spark: SparkSession, lists: dict[str, list[str]]) -> DataFrame:
    """Term lists by section as ``(section, pos, term)``.

    Handed over as Arrow, so it is a local relation of the plan: of known size, and not
    read back through Python workers each time it is used.
    """
    rows = [(s, i, t) for s, words in lists.items() for i, t in enumerate(words)]
    columns = zip(*rows) if rows else ([], [], [])
    types = (pa.string(), pa.int64(), pa.string())
    arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
    return spark.createDataFrame(pa.table(arrays, names=["section", "pos", "term"]))
