"""Status of stored rows, kept beside the store as changes and merged when read.

Marking rows writes a small part: the keys and the columns that change. Reading takes, for
each column, the last change that is not null. Compaction folds all parts into one that
replaces them. Changes are laid out by the hash of the key like the store itself, so
neither reading nor compaction exchanges a table, and the store is never rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexfit.session import stage
from lexfit.sources.keyed import BUCKETS, keyed_table, write_part

STATUS = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "file_name", "letter_done", "sent")])
COLUMNS = ("file_name", "letter_done", "sent")
STRIDE = 1 << 32


def _table(spark: SparkSession, path: str, buckets: int) -> str:
    return keyed_table(spark, path, STATUS, part="change_no", buckets=buckets)


def add_changes(spark: SparkSession, path: str, changes: DataFrame, number: int, buckets: int = BUCKETS) -> None:
    """Writes the changes (url and some of the status columns) of one run, numbered from 0; again for the same number: replaced.

    A url that comes twice keeps, per column, the greater value; rows without a url are left out.
    """
    have = set(changes.columns)
    full = changes.where("url is not null").select("url", *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in COLUMNS])
    one = full.repartition(buckets, "url").groupBy("url").agg(*[F.max(c).alias(c) for c in COLUMNS])
    write_part(spark, _table(spark, path, buckets), one, (number + 1) * STRIDE, part="change_no", buckets=buckets)


def read_status(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """url, file_name, letter_done and sent: the last change of each. A compacted part stands for all up to it."""
    changes = spark.table(_table(spark, path, buckets))
    base = changes.where(f"change_no % {STRIDE} = 1").agg(F.coalesce(F.max("change_no"), F.lit(0))).scalar()
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("change_no"))).alias(c) for c in COLUMNS]
    return changes.where(F.col("change_no") >= base).groupBy("url").agg(*last)


def with_status(store: DataFrame, status: DataFrame) -> DataFrame:
    """``store`` with its status columns overlaid by those of ``status``; columns it lacks are added."""
    names = {c: f"_{c}" for c in COLUMNS}
    joined = store.join(status.withColumnsRenamed(names), "url", "left")
    have = set(store.columns)
    merged = {c: F.coalesce(f"_{c}", c) if c in have else F.col(f"_{c}") for c in COLUMNS}
    return joined.withColumns(merged).select(*store.columns, *[c for c in COLUMNS if c not in have])


def compact(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """Folds all changes into one part. It counts once its files are committed, and leaves the changes it stands
    for, which ``drop_folded`` removes; a run that is cut off before changes nothing that is read."""
    last = spark.table(_table(spark, path, buckets)).agg(F.max("change_no")).first()[0]
    if last is not None and last % STRIDE == 0:
        folded = stage(read_status(spark, path, buckets), "status")
        write_part(spark, _table(spark, path, buckets), folded, last + 1, part="change_no", buckets=buckets)


def drop_folded(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """Empties the parts that a compacted part stands for."""
    name = _table(spark, path, buckets)
    numbers = sorted(int(r[0].split("=")[1]) for r in spark.sql(f"SHOW PARTITIONS {name}").collect())  # a number per part
    base = max((n for n in numbers if n % STRIDE == 1), default=0)
    for n in numbers:
        if n < base:
            write_part(spark, name, spark.createDataFrame([], STATUS), n, part="change_no", buckets=buckets)
