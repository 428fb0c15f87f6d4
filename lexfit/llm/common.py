"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import shutil
import sys
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfit.session import stage

WORD = r"[^\x20\x09-\x0D]+"
#: A table is broadcast only if its measured cells add up to no more than this.
BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 64


_shipped: set[str] = set()


#: Rows of whole texts that go to a Python worker at a time, where the session has Spark's default of 10,000.
ARROW_ROWS = 1000
#: Bytes that go at a time, where the session has not chosen: one long text is a batch of its own.
ARROW_BYTES = 4 * 1024 * 1024


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application; they may not have it installed.

    Sets two things for the session: shuffle files may go once a table is written, and
    Python workers get smaller batches, unless their size has been chosen already.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='lexfit-')}/lexfit", "zip", root, "lexfit"))
        _shipped.add(sc.applicationId)
    # stage tables are read again, not shuffles: their files may go as soon as a table is written
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if not sc.getConf().contains("spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the rows that no model learns from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_kept: dict[str, object] = {}
#: The last task that went through texts here.
_tasks: list[int | None] = []
#: The C library's name for the size from which a block is mapped apart, and that size in bytes.
MMAP_THRESHOLD, LARGE_BLOCK = -3, 1 << 20


def kept(name: str, make: Callable[[], object]) -> object:
    """What this worker process keeps between tasks under ``name``, until a task of another kind goes through texts."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


@cache
def c_library() -> ctypes.CDLL | None:
    """The C library, told to hand back large blocks as soon as they are free; None where it can't be."""
    if sys.platform != "linux" or not hasattr(lib := ctypes.CDLL(None), "malloc_trim"):
        return None
    lib.mallopt(MMAP_THRESHOLD, LARGE_BLOCK)
    return lib


def forget(keep: str = "") -> None:
    """Lets go what this worker process has kept from earlier tasks, all but ``keep``, and hands free memory back.

    A worker serves tasks of many kinds; what one of them has freed would else stay with the process beside the next.
    """
    task = context.taskAttemptId() if (context := TaskContext.get()) else None
    if task in _tasks and task is not None:
        return
    _tasks[:] = [task]
    for name in [name for name in _kept if name != keep]:
        del _kept[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if lib := c_library():
        lib.malloc_trim(0)


def grouped(batches: Iterator[pa.RecordBatch], size: int = 1 << 21, keep: str = "") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches of about ``size`` bytes of text or one row, with the texts.

    Of what the worker process has kept from earlier tasks all but ``keep`` is let go.
    """
    forget(keep)
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + size, "right")))
            part = batch.slice(at, end - at)
            yield part, part.column("text").to_pylist()
            at = end


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a staged table's cells: 16 a cell, and the length of strings and binaries."""
    parts = [F.lit(16 * len(df.columns))]
    parts += [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return df.agg(F.coalesce(F.sum(total.cast("long")), F.lit(0))).first()[0]


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", spread: Iterable[str] = ()) -> DataFrame:
    """Join a staged table with one row per key to ``left``, whatever the share of one key.

    ``right`` is broadcast if its measured bytes stay under ``BROADCAST_BYTES``. Otherwise
    both sides are salted: the left by a hash of the ``spread`` columns (all columns if
    none are named), the right by one copy per salt, so that a key with a third of all
    rows is dealt to ``SALTS`` tasks. The rows are the same either way. ``how``: inner or left.
    """
    if measured_bytes(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), keys, how)
    salt = F.pmod(F.xxhash64(*(list(spread) or left.columns)), F.lit(SALTS)).cast("int")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # the planner counts the copies as one, and might broadcast them all
    return left.withColumn("_salt", salt).join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def staged_list(rows: list[tuple], spark: SparkSession, schema: str, name: str) -> DataFrame:
    return stage(spark.createDataFrame(rows, schema), name)
