"""Selection of rows and output tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfit import fixed_values as fx
from lexfit.functions import records as R
from lexfit.functions.text import strip
from lexfit.operators.joins import value_filter
from lexfit.sources.manifest import committed_files, write_committed


def eligible(
    thresholds: dict[str, float] = fx.THRESHOLDS,
    suffix: str = "_jaccard",
    done: str = "letter_done",
) -> Column:
    """All three section scores over their thresholds, or the total over its own, and not
    done yet. A missing score passes no threshold."""
    def over(name: str) -> Column:
        return F.col(f"{name}{suffix}") > F.lit(thresholds[name])

    enough = (over("tasks") & over("profile") & over("benefits")) | over("total")
    return F.coalesce(enough, F.lit(False)) & ~F.col(done).eqNullSafe(fx.DONE)


def select_eligible(df: DataFrame, **options) -> DataFrame:
    return df.where(eligible(**options))


def letter_texts(about: str, start_date: str, place: str, today: Column) -> list[Column]:
    """The text columns of a letter, from ``title``, ``company``, ``address``."""
    title = F.col("title")
    return [
        R.fill(fx.PLACE_DATE, place=F.lit(place), today=F.date_format(today, "dd.MM.yyyy")).alias("place_date"),
        R.address_lines(F.col("address")).alias("address_block"),
        R.fill(fx.SUBJECT_LINE, title=title).alias("subject_line"),
        F.lit(fx.SALUTATION).alias("salutation"),
        R.fill(fx.LETTER_INTRO, title=title).alias("intro"),
        R.fill(fx.LETTER_CLOSING, about=F.lit(about), start_date=F.lit(start_date)).alias("closing"),
    ]


def prompt_text(title: Column, company: Column, matched: Column) -> Column:
    """Prompt for a text service, as a column only; nothing is called."""
    return R.fill(fx.PROMPT, title=title, company=company, matched=matched)


def letter_file_name(company: Column, title: Column) -> Column:
    return R.safe_file_name(company, title, prefix=fx.LETTER_PREFIX)


def mark_done(df: DataFrame, selected: Column) -> DataFrame:
    """File name and 'done' on the selected rows; others keep what they have."""
    name = letter_file_name(F.col("company"), F.col("title"))
    return df.withColumns(
        {
            "file_name": F.when(selected, name).otherwise(F.col("file_name")),
            "letter_done": F.when(selected, fx.DONE).otherwise(F.col("letter_done")),
        }
    )


def to_send() -> Column:
    """Rows with an address, a letter, and not sent yet."""
    has_mail = F.coalesce(strip(F.col("email")) != "", F.lit(False))
    return has_mail & F.col("letter_done").eqNullSafe(fx.DONE) & ~F.col("sent").eqNullSafe(fx.DONE)


def outbox(df: DataFrame, name: str, letter_dir: str, cv_path: str, references_path: str) -> DataFrame:
    """Mail table: recipient, subject, body and three attachment paths."""
    title = F.col("title")
    letter = F.concat(F.lit(letter_dir + "/"), F.col("file_name"), F.lit(".pdf"))
    return df.where(to_send()).select(
        "url",
        F.col("email").alias("recipient"),
        R.fill(fx.MAIL_SUBJECT, title=title).alias("subject"),
        R.fill(fx.MAIL_BODY, title=title, name=F.lit(name)).alias("body"),
        letter.alias("letter_path"),
        F.lit(cv_path).alias("cv_path"),
        F.lit(references_path).alias("references_path"),
    )


def mark_sent(df: DataFrame) -> DataFrame:
    return df.withColumn("sent", F.when(to_send(), fx.DONE).otherwise(F.col("sent")))


def page_archive(selected: DataFrame, pages: DataFrame) -> DataFrame:
    """``(url, file_name, html)`` of the selected ads.

    Only keys and names of the selection meet the pages; both sides are unique on url. Pages
    that are surely not selected stay where they are; the planner brings the names to the
    others by broadcast or shuffle as their bytes allow.
    """
    names = selected.select("url", R.safe_file_name(F.col("company"), F.col("title")).alias("file_name"))
    wanted = pages.select("url", "html").where(value_filter(names, "url")(F.col("url")))
    return wanted.join(names, "url").select("url", "file_name", "html")


def write_page_archive(archive: DataFrame, path: str, buckets: int = 256, number: int = 0) -> bool:
    """Commits the archive as part ``number`` of the folder ``path``, in ``buckets`` folders by url.

    One row per ad with its file name: a file per ad would flood any shared storage. False if
    that part is there already.
    """
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).alias("bucket")
    rows = archive.select("*", bucket)
    return write_committed(archive.sparkSession, path, lambda folder: rows.write.partitionBy("bucket").parquet(folder), number)


def read_page_archive(spark: SparkSession, path: str, numbers: tuple[int, ...] = (0,)) -> DataFrame:
    """What ``write_page_archive`` committed, whatever other attempts have left."""
    files = committed_files(spark, path, list(numbers))
    schema = "url string, file_name string, html string"
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
