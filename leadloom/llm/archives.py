"""WARC records in ZIP packages, and a reader that finds and reads them by byte range.

A package is a ZIP file (ZIP64) whose members are stored, not compressed: ``archive/data.warc.gz``
(each record a gzip member of its own), ``indexes/index.cdxj`` (a line per record: id, offset,
length) and ``datapackage.json``. The reader parses the end record, the ZIP64 locator and
directory, and the central directory; a member's bytes are then a range of the package, the index
gives each record's range in it, and tasks read just these ranges: nothing is unpacked.

Pages with equal payloads are stored once: the page with the smallest id is the response, the
others are revisits that name it. Null html is an empty payload; null urls are left out of the
headers. Rows without an id are revisits of a numbered page with their payload, else responses.
Several rows of the smallest id are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom import session
from leadloom.llm import common

#: A package is closed at this size; records are read in runs of about this size.
PACKAGE_BYTES = 64 << 20
RUN_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
LEVEL = 6


def with_first(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html`` and ``first``: the smallest id among equal payloads.

    Payloads under ``min_bytes`` are first for themselves. Equal payloads are those of equal SHA-1
    and length. The join moves the pages; Spark splits a payload that very many pages have.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce("html", F.lit("")).alias("html"))
    slim = slim.withColumns({"sha1": F.sha1(F.col("html").cast("binary")),
                             "size": F.octet_length("html")})
    firsts = slim.filter(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(
        F.min("page_id").alias("first"))
    joined = slim.join(firsts, ["sha1", "size"], "left")
    return joined.select("page_id", "url", "html", F.when(
        F.col("size") >= min_bytes, F.col("first")).otherwise(F.col("page_id")).alias("first"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One record; a revisit keeps the HTTP head and leaves the payload out."""
    revisit = page_id != first
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head if revisit else head + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Date": DATE, "WARC-Page-ID": "" if page_id is None else str(page_id),
        "WARC-Payload-Digest": "sha1:" + digest(payload),
        "Content-Type": "application/http; msgtype=response"}
    if url is not None:
        fields["WARC-Target-URI"] = " ".join(url.split())
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{first}')}>"
        fields["WARC-Refers-To-Page-ID"] = str(first)
    lines = [f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": len(block)}).items()]
    return ("WARC/1.1\r\n" + "".join(lines) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[:int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


class _Package:
    """A package being written; records first, then index and description."""

    def __init__(self, store, path: str):
        self.out = store.open_output_stream(path, compression=None)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(self._info(DATA), "w", force_zip64=True)
        self.size, self.index = 0, []

    @staticmethod
    def _info(name: str) -> zipfile.ZipInfo:
        return zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0))

    def add(self, page_id: int | None, raw: bytes) -> None:
        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        packed = squeeze.compress(raw) + squeeze.flush()
        self.member.write(packed)
        self.index.append(json.dumps({"page": page_id, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> int:
        self.member.close()
        for name, lines in ((INDEX, self.index), (ABOUT, [json.dumps(
                {"profile": "data-package", "records": len(self.index)})])):
            with self.zip.open(self._info(name), "w", force_zip64=True) as member:
                member.write("".join(x + "\n" for x in lines).encode())
        self.zip.close()
        self.out.close()
        return len(self.index)


def write(pages: DataFrame, folder: str, min_bytes: int = 0,
          package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write all pages into packages below ``folder`` (any place that all executors reach).

    Rows ``package, records, bytes`` come back lazily, so write them to a table once. A task that runs
    again writes files of new names; only those of the rows that were kept are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        package, name = None, ""
        for page_id, url, html, first in common.rows_of(batches, "page_id", "url", "html", "first"):
            if package is None:
                name = f"{uuid.uuid4().hex}.wacz"
                package = _Package(store, f"{base}/{name}")
            package.add(page_id, record(page_id, url, html.encode(), first))
            if package.size >= package_bytes:
                yield done(name, package)
                package = None
        if package is not None:
            yield done(name, package)

    def done(name: str, package: _Package) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"package": [name], "records": [package.close()], "bytes": [package.size]})

    return with_first(pages, min_bytes).mapInArrow(run, "package string, records long, bytes long")


def directory(f, size: int) -> dict[str, tuple[int, int]]:
    """Offset and size of each stored member's bytes, by the ZIP or ZIP64 central directory."""
    tail_at = max(0, size - 65_557)
    tail = f.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator:locator + 4] == b"PK\x06\x07":
        at64 = struct.unpack_from("<Q", tail, locator + 8)[0]
        end64 = f.read_at(56, at64)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    central, at, out = f.read_at(length, start), 0, {}
    for _ in range(count):
        if central[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", central, at + 10)
        packed, plain, n, extra, comment = struct.unpack_from("<IIHHH", central, at + 20)
        header, = struct.unpack_from("<I", central, at + 42)
        name = central[at + 46:at + 46 + n].decode()
        x, stop = at + 46 + n, at + 46 + n + extra
        while x + 4 <= stop:
            kind, wide = struct.unpack_from("<HH", central, x)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{wide // 8}Q", central, x + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            x += 4 + wide
        if method:
            raise ValueError(f"member {name} is not stored")
        local = f.read_at(30, header)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        out[name] = (header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        at = stop + comment
    return out


def locate(packages: DataFrame, folder: str, tasks: int | None = None) -> DataFrame:
    """``package, offset, length`` of each record, by the packages' indexes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for (name,) in common.rows_of(batches, "package"):
            path = f"{base}/{name}"
            with store.open_input_file(path) as f:
                members = directory(f, f.size())
                at, size = members[INDEX]
                lines = f.read_at(size, at).splitlines()
            start = members[DATA][0]
            found = [json.loads(x) for x in lines]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(found)), pa.array([start + x["offset"] for x in found],
                                                         pa.int64()),
                 pa.array([x["length"] for x in found], pa.int64())],
                ["package", "offset", "length"])

    tasks = tasks or packages.sparkSession.sparkContext.defaultParallelism
    return packages.select("package").repartition(tasks, "package").mapInArrow(
        run, "package string, offset long, length long")


def read(packages: DataFrame, folder: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Range-read all records: ids, target, type, digest, size and the payload (null: revisit).

    A run of ``run_bytes`` of a package is read by one task. There are as many tasks as the
    packages' ``bytes`` have runs, whatever the size of the index rows that are dealt to them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        last, f = None, None
        for batch in batches:
            out = []
            for name, offset, length in common.rows_of([batch], "package", "offset", "length"):
                if name != last:
                    if f is not None:
                        f.close()
                    last, f = name, store.open_input_file(f"{base}/{name}")
                headers, http, payload = parse(zlib.decompress(f.read_at(length, offset), 31))
                own = headers["warc-payload-digest"].removeprefix("sha1:")
                size = int(http.lower().rpartition(b"content-length:")[2])
                revisit = headers["warc-type"] == "revisit"
                if not revisit and (digest(payload) != own or len(payload) != size):
                    raise ValueError(f"record at {offset} of {name} is damaged")
                page, refers = headers["warc-page-id"], headers.get("warc-refers-to-page-id")
                out.append((int(page) if page else None, headers.get("warc-target-uri"), size, own,
                            headers["warc-type"], int(refers) if refers else None,
                            None if revisit else payload))
            columns = list(zip(*out)) if out else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                     pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to",
                 "payload"])
        if f is not None:
            f.close()

    size = packages.agg(F.count("*").alias("n"), F.coalesce(
        F.sum(F.ceil(F.col("bytes") / run_bytes)), F.lit(0)).alias("runs")).head()
    runs = locate(packages, folder, max(1, size["n"])).withColumn(
        "run", F.expr(f"offset div {run_bytes}"))
    placed = runs.repartition(max(1, size["runs"]), "package", "run").sortWithinPartitions("package", "offset")
    return placed.select("package", "offset", "length").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, "
             "record_type string, refers_to long, payload binary")


def digests(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to packages, read them back, and give what they hold."""
    folder = session.fresh_path(pages.sparkSession, "packages")
    packages = common.staged(write(pages, folder, min_bytes), "package-list")
    return read(packages, folder).drop("payload", "url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (1 + (('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT
              >> (15 - 5 * (i % 4))::INT) % 32)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f"""
