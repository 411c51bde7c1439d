"""Packages of WARC records: round trips, the directory parser, and revisits."""

import base64
import hashlib
import zipfile

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from leadloom.llm import archives, common

ROWS = [
    (5, "http://a/1", "<p>one</p>", 1), (3, "http://a/2", "<p>one</p>", 1), (9, None, None, 1),
    (8, "http://a/3", "", 1), (1, "http://b/\nx", "é\r\n\r\nzwei", 1), (None, "http://c", "<p>one</p>", 1),
    (None, "http://c", "alone", 1), (4, "http://d", "x" * 200_000, 1), (6, "http://d", "y", 1),
    (6, "http://d", "y", 1),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        ROWS, "page_id long, url string, html string, first int").repartition(3)


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_with_revisits(pages, tmp_path):
    folder = f"file://{tmp_path}/p"
    packages = archives.write(pages, folder, package_bytes=500).cache()
    rows = archives.read(packages, folder, run_bytes=300).collect()
    first = {"<p>one</p>": 3, "": 8, None: 8}
    want = [(i, " ".join(u.split()) if u else None, len((h or "").encode()), sha(h),
             *(("response", None) if i == first.get(h, i) else ("revisit", first[h]))) for i, u, h, _ in ROWS]
    assert sorted(map(repr, (tuple(r)[:6] for r in rows))) == sorted(map(repr, want))
    assert {bytes(r.payload) for r in rows if r.payload is not None} == {
        (h or "").encode() for i, _, h, _ in ROWS}
    assert all((r.payload is None) == (r.record_type == "revisit") for r in rows)


def test_small_payloads_may_be_kept_apart(pages):
    rows = archives.digests(pages, min_bytes=5).collect()
    assert {r.record_type for r in rows if r.payload_bytes < 5} == {"response"}
    assert sum(r.record_type == "revisit" for r in rows) == 2


def test_packages_are_plain_zip_files(pages, tmp_path):
    archives.write(pages, f"file://{tmp_path}/p").collect()
    for path in (tmp_path / "p").iterdir():
        with zipfile.ZipFile(path) as z, pa.OSFile(str(path)) as f:
            assert z.testzip() is None
            members = archives.directory(f, f.size())
            assert list(members) == [archives.DATA, archives.INDEX, archives.ABOUT]
            for name, (at, size) in members.items():
                assert f.read_at(size, at) == z.read(name)


def test_directories_without_zip64_with_comments_and_damage(tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a", b"first")
        z.writestr("b/ö", b"")
        z.comment = b"PK a comment"
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        members = archives.directory(f, f.size())
        assert [f.read_at(s, a) for a, s in members.values()] == [b"first", b""]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"first" * 99)
    with pa.OSFile(str(path)) as f, pytest.raises(ValueError, match="not stored"):
        archives.directory(f, f.size())
    path.write_bytes(b"no archive")
    with pa.OSFile(str(path)) as f, pytest.raises(ValueError, match="no end"):
        archives.directory(f, f.size())


def test_damaged_records_are_refused(pages, tmp_path):
    good = archives.record(1, "u", b"payload", 1)
    headers, _, payload = archives.parse(good)
    assert payload == b"payload" and headers["warc-type"] == "response"
    with pytest.raises(ValueError):
        archives.parse(b"HTTP/1.1 200 OK\r\n\r\n")


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.digests(none).count() == 0


def test_reading_tasks_follow_the_payload(spark, tmp_path):
    """Many small records: a task for each run of bytes, though the index rows are few bytes."""
    rows = [(i, "u", f"{i} " + hashlib.sha512(str(i).encode()).hexdigest() * 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    packages = common.staged(archives.write(df, f"file://{tmp_path}/w"), "package-list")
    total = packages.agg(F.sum("bytes")).head()[0]
    found = archives.read(packages, f"file://{tmp_path}/w", run_bytes=total // 10)
    tasks = found.select(F.spark_partition_id().alias("t")).distinct().count()
    assert found.rdd.getNumPartitions() >= 10 and tasks >= 5
    assert sorted((r.page_id, r.payload.decode()) for r in found.collect()) == [(i, h) for i, _, h in rows]
