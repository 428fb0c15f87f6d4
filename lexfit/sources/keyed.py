"""Tables laid out by a hash of their key, written part by part.

A table is a folder of parquet files, one subfolder per part, in which each file belongs
to one bucket of the key's hash. It is registered in the session under a name made from
its path, so that Spark knows the layout: joins and aggregates on the key read each
bucket where it lies and do not exchange the table, and a lookup of a few keys opens only
their buckets' files. A part is replaced as a whole, so writing it again changes nothing.
The number of buckets belongs to the layout: use the same one for the life of a table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexfit.operators.joins import value_filter
from lexfit.session import stage

BUCKETS = 16
#: A batch of at most so many keys names them in the scan, which then skips the other buckets.
NAMED_KEYS = 1000


def _type(field: T.StructField) -> str:
    return f"`{field.name}` {field.dataType.simpleString()}"


def keyed_table(spark: SparkSession, path: str, schema: T.StructType, key: str = "url", part: str = "batch_no", buckets: int = BUCKETS) -> str:
    """Registers the table at ``path``, which need not exist yet, and returns its name."""
    name = "keyed_" + hashlib.md5(f"{path} {buckets}".encode()).hexdigest()
    fields = [f for f in schema.fields if f.name != part]
    columns = ", ".join(map(_type, [*fields, T.StructField(part, T.LongType())]))
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (`{part}`) "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name


def write_part(spark: SparkSession, name: str, rows: DataFrame, number: int, key: str = "url", part: str = "batch_no", buckets: int = BUCKETS) -> None:
    """Replaces one part: a file per bucket that has rows."""
    columns = [f.name for f in spark.table(name).schema.fields if f.name != part]
    view = f"rows_{name}"
    rows.select(*columns).repartition(buckets, key).createOrReplaceTempView(view)
    spark.sql(f"INSERT OVERWRITE {name} PARTITION (`{part}` = {int(number)}) SELECT * FROM {view}")
    spark.catalog.dropTempView(view)


def named_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` cut down to the keys of a small batch, by name; all of them for a larger one, which has keys in every bucket."""
    few = keys.select(key).where(F.col(key).isNotNull()).limit(NAMED_KEYS + 1).collect()
    return rows if len(few) > NAMED_KEYS else rows.where(F.col(key).isin([r[0] for r in few]))


def add_new_keys(spark: SparkSession, name: str, batch: DataFrame, number: int, key: str = "url", order: str = "pos", buckets: int = BUCKETS) -> None:
    """Writes the part ``number``: the first row by ``order`` of each key of ``batch`` that no earlier part has.

    Of the batch, keys and order are exchanged to meet the buckets; the stored keys stay
    where they are. Only the rows that are new move, once, to their bucket's file.
    """
    staged = stage(batch, "batch", codec="zstd")
    firsts = staged.groupBy(key).agg(F.min(order).alias("_order"))
    earlier = spark.table(name).where(F.col("batch_no") < number).select(key)
    fresh = stage(firsts.join(named_keys(earlier, firsts, key), key, "left_anti"), "fresh").withColumnRenamed(key, "_key")
    maybe = value_filter(fresh, "_key", "_order")(F.col(key), F.col(order))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(order).eqNullSafe(F.col("_order"))
    rows = staged.where(maybe).join(fresh, same, "left_semi")
    # rows of equal key and order: any one of them; dealt as the part is, so that they move once
    write_part(spark, name, rows.repartition(buckets, key).dropDuplicates([key]), number, key, buckets=buckets)
