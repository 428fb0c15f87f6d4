"""Packing, mixing, archives, and the pipeline, with exact round trips and DuckDB."""

import base64
import gzip
import hashlib
import io
import random
import zipfile
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexfit.llm import jaccard_join, mixing, packing, queries, queries_sql, warc

SMALL = "/root/testdata/sf0.001"


def check_packed(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    by_piece = {(r.doc_id, r.piece): r for r in rows}
    assert len(by_piece) == len(rows)
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            r, part = by_piece.pop((i, k // capacity)), ids[k : k + capacity]
            assert (r.start, r.length, r.ids_crc32) == (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert not by_piece
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= capacity
    return len(ends)


def test_packing_is_whole_and_gapless(make, awkward):
    rng = random.Random(21)
    texts = awkward + [" ".join(rng.choice(["word", "Ünïcode,", "foo!bar", "naïve..."]) for _ in range(rng.randint(1, 90))) for _ in range(120)]
    rows = packing.apply(make(texts), queries.tokenizer_path(), 128).collect()
    sequences = check_packed(rows, texts, 128)
    assert sequences <= -(-sum(r.length for r in rows) // 128) + 3
    assert packing.apply(make([]), queries.tokenizer_path()).count() == 0
    assert [r.doc_id for r in packing.apply(make(["a", None], ids=[None, None]), queries.tokenizer_path()).collect()] == [None, None]


def test_items_are_made_and_numbered_by_one_python_worker_a_task(make, monkeypatch):
    staged = {}

    def stage(df, name, *more):
        staged.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return real(df, name, *more)

    real = packing.stage
    monkeypatch.setattr(packing, "stage", stage)
    rows = packing.apply(make(["a b c d", None, "", "e f"] * 30), queries.tokenizer_path(), 16).collect()
    assert len(rows) == 120
    assert staged["pack-items"].count("MapInArrow") == 1


def test_the_tokenizer_gets_new_words_by_the_thousand(monkeypatch):
    class Counting:
        def encode_batch_fast(self, texts, **more):
            calls.append(sum(len(t.split()) for t in texts))
            return real.encode_batch_fast(texts, **more)

        def __getattr__(self, name):
            return getattr(real, name)

    rng, calls = random.Random(23), []
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(rng.randint(1, 9))) for _ in range(3 * packing.LEARN_WORDS)]
    encoder = packing.Encoder(queries.tokenizer_path())
    real, encoder.tokenizer = encoder.tokenizer, Counting()
    (got,) = encoder.encode([" ".join(words)])
    assert np.frombuffer(got, "<u4").tolist() == real.encode(" ".join(words), add_special_tokens=False).ids
    assert 1 < len(calls) and max(calls) <= packing.LEARN_WORDS


def test_packing_in_rounds(spark):
    rng = random.Random(22)
    lengths = [rng.randint(1, 2048) for _ in range(3000)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack(items, rows_per_task=200).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and r.length == lengths[r.doc_id]
        ends[r.sequence_id] = r.offset + r.length
    at_once = packing.best_fit(np.array(lengths), 2048)[0].max() + 1
    assert max(ends.values()) <= 2048 and len(ends) <= 1.03 * at_once


def test_best_fit_takes_the_tightest_bin():
    bins, offsets = packing.best_fit(np.array([60, 70, 30, 40, 30]), 100)
    assert bins.tolist() == [1, 0, 0, 1, 2] and offsets.tolist() == [0, 0, 70, 60, 0]


@pytest.mark.parametrize("case", ["plain", "skewed", "awkward", "none"])
def test_mix_equals_sql(make, awkward, case):
    rng = random.Random(23)
    n = {"none": 0, "awkward": len(awkward)}.get(case, 200)
    texts = awkward if case == "awkward" else ["w " * rng.randint(0, 60) for _ in range(n)]
    sources = [rng.choice(["b", "a", "Z", "é", None, "c"]) if case != "skewed" or rng.random() < 0.2 else "a" for _ in range(n)]
    ids = [None if rng.random() < 0.02 else i for i in range(n)]
    docs = make(texts, sources, ids=ids)
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if n:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in docs.collect()])
    want = con.execute(queries_sql.SQL["op4_mix_sources"]).fetchall()
    key = lambda r: tuple((x is None or x != x, 0 if x is None or x != x else float(x)) for x in r)
    assert sorted(map(key, want)) == sorted(map(key, got.itertuples(index=False)))
    assert not n or (got["taken"] <= 3 * got["size"]).all()


def test_mixed_rows_repeat_rows(make):
    docs = make(["a b c d"] * 30 + ["e"], ["big"] * 30 + ["small"])
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(docs).collect()}
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    got = {}
    for r in rows.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in taken.items() if n} and taken[30] == 3


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c\r\nd", "short"), (4, "http://d", "short"), (5, "u", None), (None, "n", big), (6, "u", "é" * 600), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write(pages.repartition(3), f"file://{tmp_path}/w", archive_bytes=500)
    got = warc.read(archives).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
        is_copy = html == big.encode() and r.page_id != 2
        assert (r.record_type, r.refers_to) == (("revisit", 2) if is_copy else ("response", None))
        assert r.payload is None if is_copy else bytes(r.payload) == html
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_zip64_directories_and_missing_index(spark, tmp_path, monkeypatch):
    raw = [warc.record(i, f"http://{i}", bytes([65 + i]) * 50, hashlib.sha1(bytes([65 + i]) * 50).hexdigest(), None, False) for i in range(4)]
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\5\6 is not the end"
        z.writestr("other.txt", "x" * 300)
        z.writestr("archive/a.warc.gz", b"".join(raw))
    assert warc.LOCATOR64 in buffer.getvalue() and warc.END64 in buffer.getvalue()
    path = tmp_path / "wide.wacz"
    path.write_bytes(buffer.getvalue())
    with warc.open_uri(str(path)) as f:
        assert [(m.name, m.size) for m in warc.directory(f)] == [("other.txt", 300), ("archive/a.warc.gz", sum(map(len, raw)))]
    archives = spark.createDataFrame([(str(path),)], "archive string")
    assert sorted((r.page_id, bytes(r.payload)) for r in warc.read(archives).collect()) == [(i, bytes([65 + i]) * 50) for i in range(4)]
    bad = tmp_path / "bad.wacz"
    bad.write_bytes(b"no zip")
    with pytest.raises(ValueError), warc.open_uri(str(bad)) as f:
        warc.directory(f)


def test_pipeline_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "personal_data", "mixture", "packed"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, texts = docs.columns, None
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, step(spark, docs, SMALL).cache()
        if name == "near_duplicates":
            groups = {r.doc_id: r.component_id for r in jaccard_join.join(before).collect()}
            assert {r.doc_id for r in docs.collect()} == set(groups.values())
        if name == "mixture":
            texts = sorted(r.text or "" for r in docs.collect())
        if name != "packed":
            assert docs.columns == columns and docs.count()
    assert sum(r.piece == 0 for r in docs.collect()) == len(texts)


@pytest.mark.parametrize("name", sorted(queries_sql.SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    want = con.execute(queries_sql.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_mixed_rows_keep_columns_of_any_name(spark):
    names = ["_key", "_null", "_name", "_copy", "target", "whole", "threshold", "source_size", "row", "col", "_salt", "rest"]
    rows = [(i, "a b c " * (i % 5), ["s", "t", None][i % 3], *range(i, i + len(names))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(docs).where("size > 0").collect()}
    got = Counter(map(tuple, mixing.mixed_rows(docs).collect()))
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert {r: n for r, n in got.items() if r[1]} == {r: taken[r[0]] for r in rows if r[1] and taken[r[0]]}


def foreign(kind, block, **fields):
    named = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:5f5f>", "WARC-Date": "2020-01-01T00:00:00Z", **{k.replace("_", "-"): v for k, v in fields.items()}, "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in named.items()) + b"\r\n" + block + b"\r\n\r\n"


HTTP = "application/http; msgtype=response"


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("with_index", [True, False])
def test_records_of_other_writers(spark, tmp_path, zipped, with_index):
    body = b"<p>hello</p>"
    chunked = b"5\r\n<p>he\r\n7;x=1\r\nllo</p>\r\n0\r\n\r\n"
    b32 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    records = [
        foreign("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", Content_Type="application/http; msgtype=request", WARC_Target_URI="http://x/"),
        foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked, Content_Type=HTTP, WARC_Payload_Digest=f"sha1:{b32}"),
        foreign("response", b"HTTP/1.1 200 OK\r\n\r\n" + body, Content_Type=HTTP),  # neither length nor digest
        foreign("response", b"HTTP/1.1 200 OK\r\n\r\n" + body, Content_Type=HTTP, WARC_Payload_Digest="sha256:" + hashlib.sha256(body).hexdigest()),
        foreign("response", b"HTTP/1.1 200 OK\r\n\r\n" + body, Content_Type=HTTP, WARC_Payload_Digest="blake3:00ff"),
        foreign("revisit", b"", WARC_Refers_To="<urn:uuid:1>"),
        foreign("resource", body, Content_Type="text/html", WARC_Record_ID="<urn:page:7>"),
    ]
    parts = [gzip.compress(r) if zipped else r for r in records]
    name = "other.warc.gz" if zipped else "other.warc"
    lines, at = "", 0
    for part in parts:
        lines += f'- 2020 {{"filename": "{name}", "offset": "{at}", "length": "{len(part)}"}}\n'
        at += len(part)
    path = tmp_path / "other.wacz"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(f"archive/{name}", b"".join(parts))
        if with_index:
            z.writestr("indexes/index.cdxj", lines + '- 2020 {"filename": "gone.warc", "offset": 1, "length": 2}\n- 2020 {"url": "x"}\n')
    rows = warc.read(spark.createDataFrame([(f"file://{path}",)], "archive string")).collect()
    got = sorted((r.record_type, r.page_id, r.payload_bytes, bytes(r.payload) if r.payload is not None else None) for r in rows if r.record_type not in ("warcinfo", "request"))
    assert [r[0] for r in got] == ["resource", *["response"] * 4, "revisit"]
    assert got[0] == ("resource", 7, len(body), body) and all(r[2:] == (len(body), body) for r in got[1:5])
    assert got[5][2:] == (None, None) and len(rows) == len(records)
    assert all(r.payload_digest == hashlib.sha1(body).hexdigest() for r in rows if r.record_type in ("response", "resource"))


def test_a_payload_that_is_not_what_its_digest_tells_is_an_error():
    raw = foreign("response", b"HTTP/1.1 200 OK\r\n\r\nchanged", Content_Type=HTTP, WARC_Payload_Digest="sha1:" + base64.b32encode(b"\0" * 20).decode())
    with pytest.raises(ValueError, match="broken"):
        warc.parse(raw)
