"""Web archives packed in ZIP files: write them, and read their records by ranges.

An archive holds WARC members and an index, all stored without compression, so that a
record is a range of the ZIP file. Each record is a gzip stream of its own, as WARC
files have it. Reading never unpacks an archive: the tail of the file gives the end
record, plain or ZIP64, that gives the central directory, and that gives each member's
place; the index members give the records' places, which Spark deals out in ranges.

Files are opened through pyarrow's file systems by their URI, for writing in the folder
the caller names, which driver and executors must share.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfit.session import scratch_path, stage

MIN_REVISIT = 1000
ARCHIVE_BYTES = 256 * 1024 * 1024
READ_BLOCK = 8 * 1024 * 1024
#: Fixed values of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
GZIP = b"\x1f\x8b"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


@dataclass
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


def open_uri(uri: str) -> pa.NativeFile:
    system, path = fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")
    return system.open_input_file(path)


def zip64_values(extra: bytes) -> Iterator[int]:
    """The 64-bit values of the ZIP64 field of a central entry."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            yield from struct.unpack_from(f"<{size // 8}Q", extra, at + 4)
        at += 4 + size


def directory(f: pa.NativeFile) -> list[Member]:
    """The members of a ZIP or ZIP64 file, from its end record and central directory alone."""
    size = f.size()
    tail_at = max(0, size - 65557)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("not a ZIP file: it has no end record")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    end_at = tail_at + at
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        f.seek(end_at - 20)
        locator = f.read(20)
        if locator[:4] != LOCATOR64:
            raise ValueError("a ZIP64 file without its locator")
        f.seek(struct.unpack_from("<Q", locator, 8)[0])
        record = f.read(56)
        if record[:4] != END64:
            raise ValueError("a ZIP64 file without its end record")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    f.seek(start)
    entries, members, at = f.read(length), [], 0
    for _ in range(count):
        if entries[at : at + 4] != CENTRAL:
            raise ValueError("a broken central directory")
        method, packed, full, names, extras, notes = struct.unpack_from("<H8xIIHHH", entries, at + 10)
        header = struct.unpack_from("<I", entries, at + 42)[0]
        wide = zip64_values(entries[at + 46 + names : at + 46 + names + extras])
        full = next(wide) if full == 0xFFFFFFFF else full
        packed = next(wide) if packed == 0xFFFFFFFF else packed
        header = next(wide) if header == 0xFFFFFFFF else header
        members.append(Member(entries[at + 46 : at + 46 + names].decode("utf-8", "replace"), method, full, packed, header))
        at += 46 + names + extras + notes
    return members


def data_start(f: pa.NativeFile, member: Member) -> int:
    f.seek(member.header)
    local = f.read(30)
    if local[:4] != LOCAL:
        raise ValueError(f"no local header for {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def content(f: pa.NativeFile, member: Member) -> bytes:
    """A whole small member, stored or deflated."""
    f.seek(data_start(f, member))
    raw = f.read(member.packed)
    return zlib.decompress(raw, -15) if member.method == 8 else raw


def block(fields: list[tuple[str, str]], first: str) -> bytes:
    return CRLF.join([first.encode(), *(f"{k}: {v}".encode() for k, v in fields), b"", b""])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One gzipped record; a revisit keeps the HTTP header, with the payload's length, but not the payload."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = block([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    body = http if is_revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{b32}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if is_revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return gzip.compress(block(fields, "WARC/1.1") + body + CRLF * 2, 4, mtime=0)


def header_fields(head: bytes) -> dict[str, str]:
    """The named fields of a header block, names in lower case; lines that are none are passed over."""
    named = (line.partition(b":") for line in head.split(b"\n")[1:])
    return {k.strip().decode("utf-8", "replace").lower(): v.strip().decode("utf-8", "replace") for k, colon, v in named if colon}


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; of one that is cut off or not chunked after all, what is there."""
    out, at = [], 0
    while True:
        line, end, _ = body[at:].partition(CRLF) if at < len(body) else (b"", b"", b"")
        try:
            size = int(line.split(b";")[0], 16)
        except ValueError:
            return b"".join(out) if out or not body else body
        at += len(line) + len(end)
        if size == 0:
            return b"".join(out)
        out.append(body[at : at + size])
        at += size + len(CRLF)


def told_digest(value: str | None) -> tuple[str, str] | None:
    """Algorithm and lower-case hex of a digest field in base32 or hex; None for one that is missing or unknown."""
    name, _, text = (value or "").partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    size = hashlib.new(name).digest_size
    try:
        raw = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError:
        return None
    return (name, raw.hex()) if len(raw) == size else None


def parse(raw: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of a record, gzipped or plain.

    Any type of record is returned. The payload is what follows the HTTP header, without
    chunks, or the whole block of records that hold no HTTP message. Its digest is SHA-1;
    one that the record tells is held against the payload, as sent or without chunks. A
    revisit has no payload; its length and digest are those it tells, null if it tells none.
    """
    plain = gzip.decompress(raw) if raw[:2] == GZIP else raw
    head, _, rest = plain.partition(CRLF * 2)
    fields = header_fields(head)
    kind = fields.get("warc-type", "")
    body = rest[: int(fields.get("content-length", len(rest)))]
    page = lambda s: int(s[10:-1]) if re.fullmatch("<urn:page:-?[0-9]+>", s) else None
    told = told_digest(fields.get("warc-payload-digest"))
    sent, http = body, {}
    if fields.get("content-type", "").lower().startswith("application/http") or kind == "revisit":
        header, _, sent = body.partition(CRLF * 2)
        http = header_fields(header)
    if kind == "revisit":
        length, payload = http.get("content-length", ""), None
        size, digest = int(length) if length.isdigit() else None, told[1] if told and told[0] == "sha1" else None
    else:
        payload = unchunked(sent) if "chunked" in http.get("transfer-encoding", "").lower() else sent
        if told and all(hashlib.new(told[0], x).hexdigest() != told[1] for x in (payload, sent)):
            raise ValueError(f"a broken record: {fields.get('warc-record-id')}")
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    refers = fields.get("warc-refers-to")
    return page(fields.get("warc-record-id", "")), fields.get("warc-target-uri"), kind, page(refers) if refers else None, size, digest, payload


class Archive:
    """One ZIP file being written: a stored WARC member, then its index, then a package description."""

    def __init__(self, uri: str) -> None:
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.stream = system.open_output_stream(path)
        self.uri, self.lines, self.at = uri, [], 0
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True)

    def add(self, raw: bytes, url: str | None) -> None:
        self.lines.append(json.dumps({"url": url, "filename": "data.warc.gz", "offset": self.at, "length": len(raw)}))
        self.member.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr("indexes/index.cdxj", "".join(f"- 19700101000000 {x}\n" for x in self.lines))
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "records": len(self.lines)}))
        self.zip.close()
        self.stream.close()


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, is_revisit and refers_to of every row.

    The response of equal payloads is found from counts that combine before their shuffle.
    Only payloads that occur more than once are looked up, in a plain join that the
    adaptive planner may split where one payload has a large share of the rows.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", payload.alias("payload"))
    keyed = keyed.withColumn("digest", F.sha1("payload")).withColumn("long", F.octet_length("payload") >= MIN_REVISIT)
    seen = keyed.where("long").groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
    often = stage(seen.where("n > 1 and first is not null").select("digest", "first"), "warc-copies")
    is_revisit = F.col("long") & F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    joined = keyed.join(often, "digest", "left").withColumn("is_revisit", is_revisit)
    return joined.withColumn("refers_to", F.when(F.col("is_revisit"), F.col("first"))).select("page_id", "url", "payload", "digest", "is_revisit", "refers_to")


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) into archives below ``folder``; returns their URIs.

    A task writes its rows to files of about ``archive_bytes``, named anew on each attempt;
    the list of archives is what the successful attempts report, so files of lost attempts
    are never read. Null html is an empty payload; a null url or page_id is left out of
    the record, and a row without a page_id is a revisit if another row has its payload.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, archive, done = TaskContext.get(), None, []
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, digest, is_revisit, refers_to = (c[row].as_py() for c in batch.columns)
                if archive is None:
                    archive = Archive(f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.wacz")
                archive.add(record(page_id, url, payload, digest, refers_to, is_revisit), url)
                if archive.at >= archive_bytes:
                    archive.close()
                    done.append(archive.uri)
                    archive = None
        if archive:
            archive.close()
            done.append(archive.uri)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(done)], ["archive"])

    return stage(decided(pages).mapInArrow(pack, "archive string"), "warc-archives")


def locate(archives: DataFrame, block_bytes: int = READ_BLOCK) -> DataFrame:
    """archive, start, length and block of every record, from directories and indexes alone.

    A WARC member without an index line is scanned from its start, for gzip streams or for
    plain records. A member that the ZIP file holds compressed has no ranges, and is an
    error. Index lines that name no member or no place are passed over.
    """

    def places(f: pa.NativeFile) -> Iterator[tuple[int, int]]:
        members = {m.name: m for m in directory(f)}
        warcs = {n: m for n, m in members.items() if n.startswith("archive/") and ".warc" in n}
        indexed: set[str] = set()
        for name, m in warcs.items():
            if m.method:
                raise ValueError(f"{name} is compressed in the ZIP file; its records have no ranges")
        for name, m in members.items():
            if name.startswith("indexes/") and ".cdx" in name:
                raw = content(f, m)
                starts: dict[str, int] = {}
                for line in io.BytesIO(gzip.decompress(raw) if name.endswith(".gz") else raw):
                    if b"{" in line:
                        entry = json.loads(line[line.index(b"{") :])
                        target = f"archive/{entry.get('filename')}"
                        if target not in warcs or not {"offset", "length"} <= entry.keys():
                            continue
                        if target not in starts:
                            starts[target] = data_start(f, warcs[target])
                            indexed.add(target)
                        yield starts[target] + int(entry["offset"]), int(entry["length"])
        for name, m in warcs.items():
            if name not in indexed:
                yield from scanned(f, data_start(f, m), m.size)

    def list_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                with open_uri(uri) as f:
                    rows = list(places(f))
                cols = [pa.array([uri] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["archive", "start", "length"])

    found = archives.select("archive").repartition("archive").mapInArrow(list_records, "archive string, start long, length long")
    return found.withColumn("block", F.floor(F.col("start") / block_bytes))


def scanned(f: pa.NativeFile, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Places and lengths of a member's records: its gzip streams, or plain records by the lengths they tell."""
    f.seek(start)
    return scanned_gzip(f, start, size) if f.read(2) == GZIP else scanned_plain(f, start, size)


def scanned_plain(f: pa.NativeFile, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Headers are read, blocks are passed over."""
    at, end = start, start + size
    while at < end:
        f.seek(at)
        head = b""
        while CRLF * 2 not in head and at + len(head) < end:
            head += f.read(min(1 << 12, end - at - len(head)))
        head, found, _ = head.partition(CRLF * 2)
        if not found:
            return
        length = len(head) + 4 + int(header_fields(head).get("content-length", 0))
        yield at, min(length, end - at)
        at += length
        f.seek(at)
        gap = f.read(min(4, max(0, end - at)))
        at += len(gap) - len(gap.lstrip(CRLF))


def scanned_gzip(f: pa.NativeFile, start: int, size: int) -> Iterator[tuple[int, int]]:
    """The gzip streams of a member, by unpacking it piece by piece."""
    at, end, ahead = start, start + size, b""
    begin, pending = start, zlib.decompressobj(31)
    while at < end or ahead:
        if not ahead:
            f.seek(at)
            ahead = f.read(min(1 << 20, end - at))
            at += len(ahead)
        pending.decompress(ahead)
        ahead = b""
        if pending.eof:
            ahead = pending.unused_data
            stop = at - len(ahead)
            yield begin, stop - begin
            begin, pending = stop, zlib.decompressobj(31)


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of ``archives``: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Records are dealt out by archive and block of READ_BLOCK bytes, and neighbours are
    read at once. A revisit has no payload of its own; length and digest are those it
    refers to. Each response is held against its digest. No archives give no rows.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, pa.NativeFile] | None = None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "start", "length")), strict=True))
            at = 0
            while at < len(rows):
                uri, begin, length = rows[at]
                stop, end = at + 1, begin + length
                while stop < len(rows) and rows[stop][0] == uri and rows[stop][1] == end and end - begin < READ_BLOCK:
                    end += rows[stop][2]
                    stop += 1
                if opened is None or opened[0] != uri:
                    if opened:
                        opened[1].close()
                    opened = (uri, open_uri(uri))
                opened[1].seek(begin)
                raw = opened[1].read(end - begin)
                got = [parse(raw[s - begin : s - begin + n]) for _, s, n in rows[at:stop]]
                cols = [pa.array([g[i] for g in got], kinds[i]) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, names)
                at = stop
        if opened:
            opened[1].close()

    dealt = locate(archives).repartition("archive", "block").sortWithinPartitions("archive", "start").select("archive", "start", "length")
    return dealt.mapInArrow(fetch, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, then read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    archives = write(pages, folder if ":" in folder else f"file://{folder}")
    return read(archives, with_payload=False)
