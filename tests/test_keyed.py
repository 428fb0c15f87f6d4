"""The store laid out by url hash and the status kept beside it."""

import re

from pyspark.sql import functions as F

from lexfit.operators import cleaning
from lexfit.sources import keyed, status
from lexfit.sources import store as S

ROW = "url string, title string, batch_no bigint, pos bigint"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_does_not_exchange_stored_urls(spark, tmp_path):
    path = str(tmp_path / "store")
    batch = spark.range(3000).selectExpr("concat('u', id) AS url", "'t' AS title", "id AS pos")
    S.append_batch(spark, path, batch, 0, buckets=4)
    store = S.read_keyed_store(spark, path, batch.schema, buckets=4)
    new = spark.range(2000, 6000).selectExpr("concat('u', id) AS url")
    joined = new.join(store.select("url").hint("merge"), "url", "left_anti")
    assert joined.count() == 3000
    text = plan(joined)
    assert "Bucketed: true" in text and len(re.findall(r"Exchange hash", text)) == 1
    assert "Exchange" not in plan(store.groupBy("url").agg(F.min("pos")))


def test_few_keys_open_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    batch = spark.range(1000).selectExpr("concat('u', id) AS url", "id AS pos")
    S.append_batch(spark, path, batch, 0, buckets=8)
    store = S.read_keyed_store(spark, path, batch.schema, buckets=8).select("url")
    few = spark.createDataFrame([("u5",), (None,), ("new",)], "url string")
    cut = keyed.named_keys(store, few, "url")
    joined = few.join(cut.hint("merge"), "url", "left_anti")
    chosen = int(re.search(r"SelectedBucketsCount: (\d+) out of 8", plan(joined)).group(1))
    assert chosen <= 2 and sorted(str(r.url) for r in joined.collect()) == ["None", "new"]
    many = spark.range(keyed.NAMED_KEYS + 1).selectExpr("concat('u', id) AS url")
    assert keyed.named_keys(store, many, "url").count() == 1000


def test_batches_with_nulls_ties_and_copies(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("a", "x", 0, 1), ("a", "y", 0, 1), (None, "n1", 0, 2), (None, "n2", 0, 1), ("b", "z", 0, None), ("hot", "first", 0, -1)]
    rows += [("hot", f"h{i}", 0, i) for i in range(2000)]
    S.append_batch(spark, path, spark.createDataFrame(rows, ROW), 0, buckets=4)
    got = sorted(map(tuple, spark.read.parquet(path).select("url", "title").collect()), key=str)
    assert got[0] in [("a", "x"), ("a", "y")]
    assert got[1:] == [("b", "z"), ("hot", "first"), (None, "n2")]
    S.append_batch(spark, path, spark.createDataFrame(rows, ROW).limit(0), 1, buckets=4)
    assert spark.read.parquet(path).count() == 4


def test_dedupe_moves_no_row_without_a_copy(spark):
    rows = [(f"u{i}", "x" * 50, 0, i) for i in range(500)] + [("u1", "later", 1, 0), ("u1", "tie", 0, 1), (None, "n", 0, 0), (None, "m", 0, 1)]
    df = spark.createDataFrame(rows, ROW)
    out = cleaning.dedupe_first(df)
    kept = {r.url: r.title for r in out.collect()}
    assert out.count() == 501 and kept["u7"] == "x" * 50 and kept[None] == "n" and kept["u1"] in ("x" * 50, "tie")
    assert sorted(out.columns) == sorted(df.columns)


def test_status_of_several_runs(spark, tmp_path):
    path = str(tmp_path / "status")
    change = lambda rows: spark.createDataFrame(rows, "url string, letter_done string, sent string")
    status.add_changes(spark, path, change([("a", "Ja", None), ("b", "Ja", None), (None, "Ja", None)]), 0)
    status.add_changes(spark, path, change([("a", None, "Ja"), ("c", "Nein", None)]), 1)
    status.add_changes(spark, path, change([("a", None, "Ja"), ("c", "Nein", None)]), 1)

    def read():
        return sorted((r.url, r.file_name, r.letter_done, r.sent) for r in status.read_status(spark, path).collect())

    want = [("a", None, "Ja", "Ja"), ("b", None, "Ja", None), ("c", None, "Nein", None)]
    assert read() == want
    status.compact(spark, path)
    assert read() == want
    status.drop_folded(spark, path)
    assert read() == want
    status.add_changes(spark, path, change([("c", "Ja", None)]), 2)
    assert read() == [*want[:2], ("c", None, "Ja", None)]
    status.compact(spark, path)
    status.compact(spark, path)
    assert read() == [*want[:2], ("c", None, "Ja", None)]
    store = spark.createDataFrame([("a", "old", "x"), ("z", "old", "y")], "url string, sent string, title string")
    merged = {r.url: r for r in status.with_status(store, status.read_status(spark, path)).collect()}
    assert merged["a"].sent == "Ja" and merged["z"].sent == "old" and merged["z"].letter_done is None and merged["a"].title == "x"


def test_reading_status_exchanges_nothing(spark, tmp_path):
    path = str(tmp_path / "status")
    rows = spark.range(500).selectExpr("concat('u', id) AS url", "'Ja' AS sent")
    for n in range(2):
        status.add_changes(spark, path, rows, n, buckets=4)
    text = plan(status.read_status(spark, path, buckets=4))
    main = text.split("Subquery")[0]
    assert "Exchange hashpartitioning(url" not in main


def test_new_rows_move_once(spark, tmp_path, monkeypatch):
    """Whole rows of a batch are dealt to the buckets and made unique there, in one exchange; their staged copy is zstd."""
    written, write_part = [], keyed.write_part

    def kept(spark, name, rows, number, key, buckets):
        written.append(rows.repartition(buckets, key))
        return write_part(spark, name, rows, number, key, buckets=buckets)

    monkeypatch.setattr(keyed, "write_part", kept)
    rows = [("a", "x", 2), ("a", "y", 1), ("a", "y", 1), (None, "z", 3), (None, "n", 2), ("b", "w", 4)]
    batch = spark.createDataFrame(rows, "url string, body string, pos long")
    S.append_batch(spark, str(tmp_path / "store"), batch, 0)
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(url", plan)) == 1, plan
    assert written[0].inputFiles() and all(".zstd." in f for f in written[0].inputFiles() if "/batch-" in f)
    got = S.read_keyed_store(spark, str(tmp_path / "store"), batch.schema).select("url", "body", "pos").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", "y", 1), (None, "n", 2), ("b", "w", 4)], key=str)
