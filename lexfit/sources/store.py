"""The keyed store: parquet by batch and url hash, CSV for exchange."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexfit.schemas import STORE
from lexfit.sources.keyed import BUCKETS, add_new_keys, keyed_table
from lexfit.sources.manifest import committed_files, write_committed

# A missing value is written as \N, so that it stays apart from an empty text. Line ends inside
# of fields are escaped, so a record is a line and a file can be read in ranges.
CSV_OPTIONS = {
    "header": True, "encoding": "UTF-8", "multiLine": False, "quote": '"', "escape": '"',
    "lineSep": "\n", "nullValue": "\\N", "maxCharsPerColumn": -1,
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def store_init(spark: SparkSession, schema: T.StructType = STORE) -> DataFrame:
    """An empty store."""
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType = STORE) -> DataFrame:
    """The columns of ``schema`` in its order and types; absent ones are null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def union_batches(*batches: DataFrame) -> DataFrame:
    """Stack batches of differing widths."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def store_append(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Existing rows first: the batch gets the next batch number.

    The number is a scalar subquery in the same plan.
    """
    last = store.agg(F.coalesce(F.max("batch_no"), F.lit(-1))).scalar()
    return union_batches(store, batch.withColumn("batch_no", (last + 1).cast("bigint")))


def read_store(spark: SparkSession, path: str, schema: T.StructType = STORE) -> DataFrame:
    """The parquet store under its explicit schema."""
    return spark.read.schema(schema).parquet(path)


def escaped(text: Column) -> Column:
    """The text on one line: backslashes doubled, line ends as backslash and letter."""
    for mark, letter in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(mark), F.lit(letter))
    return text


def unescaped(text: Column) -> Column:
    def plain(piece: Column) -> Column:
        return F.replace(F.replace(piece, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def read_csv_store(spark: SparkSession, path: str, schema: T.StructType, numbers: tuple[int, ...] = (0,)) -> DataFrame:
    """What ``write_csv_store`` committed; array columns are held as JSON text. Files are read in ranges."""
    text = [f.name for f in schema.fields if _nested(f.dataType) or isinstance(f.dataType, T.StringType)]
    flat = T.StructType([T.StructField(f.name, T.StringType() if f.name in text else f.dataType) for f in schema.fields])
    files = committed_files(spark, path, list(numbers))
    df = spark.read.schema(flat).options(**CSV_OPTIONS).csv(files) if files else spark.createDataFrame([], flat)
    df = df.select(*[unescaped(F.col(f.name)).alias(f.name) if f.name in text else F.col(f.name) for f in flat.fields])
    return df.select(
        *[
            F.from_json(f.name, f.dataType).alias(f.name) if _nested(f.dataType) else F.col(f.name)
            for f in schema.fields
        ]
    )


def write_csv_store(df: DataFrame, path: str, number: int = 0) -> bool:
    """Commits a CSV copy as part ``number`` of the folder ``path``; False if that part is there already."""
    columns = []
    for f in df.schema.fields:
        nested = _nested(f.dataType)
        value = F.to_json(f.name) if nested else F.col(f.name)
        columns.append((escaped(value) if nested or isinstance(f.dataType, T.StringType) else value).alias(f.name))
    flat = df.select(*columns)
    return write_committed(df.sparkSession, path, lambda folder: flat.write.options(**CSV_OPTIONS).csv(folder), number)


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.StructType, T.MapType))


def write_store(df: DataFrame, path: str) -> None:
    """A full copy at a new path, in folders by batch."""
    df.write.partitionBy("batch_no").parquet(path)


def append_batch(spark: SparkSession, path: str, batch: DataFrame, batch_no: int, buckets: int = BUCKETS) -> None:
    """Add the new keys of one batch to the store at ``path``, which is laid out by a hash of the url.

    The batch has its own folder, which is replaced as a whole: running the same batch
    again, after a lost driver or a replay, gives the same store. Only earlier batches
    are looked at for known keys, bucket by bucket, and only their url column is read.
    """
    schema = T.StructType([f for f in batch.schema.fields if f.name != "batch_no"])
    name = keyed_table(spark, path, schema, buckets=buckets)
    add_new_keys(spark, name, batch.drop("batch_no"), batch_no, buckets=buckets)


def read_keyed_store(spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS) -> DataFrame:
    """The store at ``path`` as Spark knows it: joins and aggregates on url need no exchange of it."""
    return spark.table(keyed_table(spark, path, schema, buckets=buckets))
