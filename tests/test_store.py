import itertools

import pytest
from pyspark.sql import functions as F

from lexfit.operators import cleaning, pages, selection
from lexfit.schemas import RECORD, STORE
from lexfit.sources import manifest
from lexfit.sources import store as S
from lexfit.streaming.incremental import follow_pages

ROW = "url string, title string, batch_no bigint, pos bigint"


def test_init_and_conform(spark):
    assert S.store_init(spark).count() == 0 and S.store_init(spark).schema == STORE
    df = S.conform(spark.createDataFrame([("u", 1)], "url string, pos int"))
    assert df.schema.names == STORE.names and df.first().pos == 1 and df.first().lang is None


def test_append_numbers_the_batch(spark):
    old = spark.createDataFrame([("a", "old", 3, 0)], ROW)
    new = spark.createDataFrame([("a", "new", "x")], "url string, title string, extra string")
    rows = {r.title: r for r in S.store_append(old, new).collect()}
    assert rows["new"].batch_no == 4 and rows["old"].extra is None
    first = S.store_append(old.limit(0), new).first()
    assert first.batch_no == 0


def test_dedupe_keeps_first_seen_and_is_idempotent(spark):
    rows = [("a", "new", 1, 0), ("a", "old", 0, 5), ("b", "x", 1, 2), ("b", "y", 1, 1), (None, "n", 0, 0)]
    df = spark.createDataFrame(rows, ROW)
    once = cleaning.dedupe_first(df)
    assert {(r.url, r.title) for r in once.collect()} == {("a", "old"), ("b", "y"), (None, "n")}
    assert sorted(map(str, cleaning.dedupe_first(once).collect())) == sorted(map(str, once.collect()))


def test_dedupe_of_a_table_keeps_the_same_rows(spark):
    rows = [(f"u{i % 40}" if i % 3 else "hot", f"t{i}", i % 4, i) for i in range(200)]
    rows += [(None, "n1", 0, 1), (None, "n0", 0, 0), ("alone", "x", None, None)]
    df = spark.createDataFrame(rows, ROW)
    want = sorted(map(tuple, cleaning.dedupe_first(df).collect()), key=str)
    assert sorted(map(tuple, cleaning.dedupe_first_table(df).collect()), key=str) == want
    plan = cleaning.dedupe_first_table(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    # Tied first copies: one of them stays.
    tied = df.union(spark.createDataFrame([("hot", "tie", 0, 0)], ROW))
    assert cleaning.dedupe_first_table(tied).groupBy("url").count().where("count > 1").isEmpty()


def test_csv_round_trip(spark, tmp_path):
    rows = [
        ("u1", 'say "hi", ok\\', "Firma; & Co", ["Weg 1", 'a "b"'], ["line\nbreak", "x,y", ""], 0, 1),
        ("u2", None, "", None, [], 1, 2),
        ("u3", " lead", "ü\tß", [""], None, 1, 3),
    ]
    df = spark.createDataFrame(rows, RECORD)
    path = str(tmp_path / "csv")
    S.write_csv_store(df, path)
    back = S.read_csv_store(spark, path, RECORD)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    rows = [(f"u{i}", "a\nb\r\n\\n\\ \\N" + "x" * 200, '"', ["\n", "\\", None], [str(i)], 0, i) for i in range(2000)] + [("n", "\\N", None, None, [], 0, -1)]
    df = spark.createDataFrame(rows, RECORD)
    path = str(tmp_path / "csv")
    assert S.write_csv_store(df.coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        back = S.read_csv_store(spark, path, RECORD)
        assert back.rdd.getNumPartitions() > 4
        assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_only_committed_parts_are_read(spark, tmp_path):
    path = str(tmp_path / "csv")
    one, two = (S.conform(spark.createDataFrame([(u, 0)], "url string, pos bigint"), RECORD) for u in ("u1", "u2"))
    assert S.write_csv_store(one, path) and not S.write_csv_store(two, path)

    def broken(folder):
        two.write.parquet(folder)
        raise OSError("executor lost")

    with pytest.raises(OSError):
        manifest.write_committed(spark, path, broken, 1)
    with pytest.raises(FileNotFoundError):
        S.read_csv_store(spark, path, RECORD, (0, 1))
    assert [r.url for r in S.read_csv_store(spark, path, RECORD).collect()] == ["u1"]
    S.write_csv_store(two, path, 1)
    assert sorted(r.url for r in S.read_csv_store(spark, path, RECORD, (0, 1)).collect()) == ["u1", "u2"]
    file = manifest.committed_files(spark, path, [0])[0].removeprefix("file:")
    with open(file, "a") as f:
        f.write("more")
    with pytest.raises(OSError):
        S.read_csv_store(spark, path, RECORD)


def test_parquet_store(spark, tmp_path):
    df = S.conform(spark.createDataFrame([("u1", 0, 1), ("u2", 1, 1)], "url string, batch_no bigint, pos bigint"))
    S.write_store(df, str(tmp_path / "s"))
    back = S.read_store(spark, str(tmp_path / "s"))
    assert {(r.url, r.batch_no) for r in back.collect()} == {("u1", 0), ("u2", 1)}


def batches(spark):
    return [
        spark.createDataFrame([("a", "a0", 0, 1), ("a", "a0 copy", 0, 2), ("b", "b0", 0, 3)], ROW),
        spark.createDataFrame([("b", "b1", 0, 1), ("c", "c1", 0, 2)], ROW),
        spark.createDataFrame([("c", "c2", 0, 1), ("d", "d2", 0, 1)], ROW),
    ]


def test_batches_and_replay(spark, tmp_path):
    path = str(tmp_path / "store")
    for n, batch in enumerate(batches(spark)):
        S.append_batch(spark, path, batch, n)
        S.append_batch(spark, path, batch, n)
    S.append_batch(spark, path, batches(spark)[1], 1)
    want = {("a", "a0", 0), ("b", "b0", 0), ("c", "c1", 1), ("d", "d2", 2)}
    assert {(r.url, r.title, r.batch_no) for r in spark.read.parquet(path).collect()} == want


def test_any_split_gives_the_same_content(spark, tmp_path):
    one = batches(spark)[0].withColumn("batch_no", F.lit(0))
    for n, batch in enumerate(batches(spark)[1:], 1):
        one = one.unionByName(batch.withColumn("batch_no", F.lit(n)))
    at_once = {(r.url, r.title) for r in cleaning.dedupe_first(one).collect()}
    path = str(tmp_path / "split")
    for n, batch in enumerate(batches(spark)):
        S.append_batch(spark, path, batch, n)
    assert {(r.url, r.title) for r in spark.read.parquet(path).collect()} == at_once


def test_stream_takes_each_file_once(spark, tmp_path):
    landing, store, offsets = (str(tmp_path / n) for n in ("landing", "store", "offsets"))
    page = "page_id bigint, url string, html string"

    def land(rows):
        spark.createDataFrame(rows, page).coalesce(1).write.mode("append").parquet(landing)

    def run():
        query = follow_pages(spark, landing, store, offsets, pages.page_records, files_per_batch=1)
        query.awaitTermination()
        assert query.exception() is None
        return {(r.url, r.parts[0]) for r in spark.read.parquet(store).collect()}

    land([(1, "u1", "first"), (2, "u1", "second"), (3, "u2", "x")])
    assert run() == {("u1", "first"), ("u2", "x")}
    land([(9, "u1", "later"), (10, "u3", "new")])
    want = {("u1", "first"), ("u2", "x"), ("u3", "new")}
    assert run() == want and run() == want


def test_archive_files(spark, tmp_path):
    landed = spark.createDataFrame([(1, "u1", "<p>1"), (2, "u2", "<p>2")], "page_id bigint, url string, html string")
    chosen = spark.createDataFrame([("u2", "A/B", "T:1")], "url string, company string, title string")
    archive = selection.page_archive(chosen, landed)
    path = str(tmp_path / "archive")
    assert selection.write_page_archive(archive, path, 4) and not selection.write_page_archive(archive, path, 4)
    assert list(map(tuple, selection.read_page_archive(spark, path).collect())) == [("u2", "A_B_T_1", "<p>2")]
    selection.write_page_archive(archive.limit(0), path, 4, number=1)
    assert selection.read_page_archive(spark, path, (0, 1)).count() == 1


def test_blocklist_keeps_rows_without_title(spark):
    rows = [(t,) for t in ("Werkstudent IT", "chemielaborant", None, "Analyst")] * 3
    df = spark.createDataFrame(rows, "title string")
    kept = cleaning.title_blocklist(df, ["werkstudent", "Chemie"]).collect()
    assert sorted(map(str, (r.title for r in kept))) == ["Analyst"] * 3 + ["None"] * 3


def test_all_columns_kept_in_union(spark):
    frames = [spark.createDataFrame([tuple(range(k))], ", ".join(f"c{i} int" for i in range(k))) for k in (1, 3, 2)]
    for order in itertools.permutations(frames):
        assert S.union_batches(*order).count() == 3
