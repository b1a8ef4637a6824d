import gzip
import hashlib
from pathlib import Path

import pytest

from facejobs.llm import warc

LONG = "<p>payload of some length</p>\r\n\r\nWARC/1.1\r\n" * 40
ROWS = [
    (1, "http://a.example/", LONG), (2, "http://b.example/x y", LONG), (9, None, LONG), (3, "http://c.example/\r\nWARC-Type: forged", "short"), (4, "", "short"), (5, "u", None), (6, "u", ""),
    (7, "u", "é" * 500), (8, "u", "é" * 500), (10, "u", "é" * 499 + "x"), (11, "u", "é" * 499 + "x"), (None, "u", LONG), (None, "u", "n" * 1000), (9, "again", LONG), (12, "u", "z" * 300_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(p, u, h, "x", 1, "y") for p, u, h in ROWS], "page_id long, url string, html string, payload string, refers_to int, check string")


def brute(rows):
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        same = [q for q, _, g in rows if (g or "").encode() == data]
        last = max((q for q in same if q is not None), default=None)
        revisit = len(data) >= 1000 and len(same) > 1 and last is not None and last != p
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/warc"
    warc.write(pages.repartition(3), folder)
    archived = warc.read(spark, folder)
    got = warc.restore(archived)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS)
    held = archived.collect()
    payloads = sorted(r.payload for r in held if r.record_type == "response")
    revisits = [r for r in held if r.record_type == "revisit"]
    assert payloads == sorted([LONG, LONG, "short", "short", "", "", "é" * 500, "é" * 499 + "x", "é" * 499 + "x", "n" * 1000, "z" * 300_000])
    assert len(revisits) == 4 and all(r.payload is None for r in revisits)
    ids = {r.record_id for r in held if r.record_type == "response"}
    assert all(r.refers_to_id in ids for r in revisits)
    assert all("\n" not in r.url and r.url for r in held) and {r.url for r in held if r.page_id == 9} == {"urn:page:9", "again"}


def test_files_are_warc(spark, pages, tmp_path):
    warc.write(pages.coalesce(1), f"file://{tmp_path}/w")
    found = [f for f in Path(tmp_path, "w").iterdir() if f.suffix == ".gz"]
    records = [r for f in found for r in warc.parse(f.read_bytes())]
    assert len(records) == len(ROWS)
    for fields, block in records:
        assert {"warc-type", "warc-record-id", "warc-date", "warc-target-uri", "content-type"} <= fields.keys()
        assert fields["warc-record-id"].startswith("<urn:uuid:") and len(fields["warc-record-id"]) == 47
        assert block.startswith(b"HTTP/1.1 200 OK\r\n") and int(fields["content-length"]) == len(block)
        assert fields["warc-type"] == "response" or (fields["warc-profile"] == warc.PROFILE and block.endswith(b"\r\n\r\n"))


def test_members_and_damage():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    many = b"".join(gzip.compress(record) for _ in range(5))
    assert [b for _, b in warc.parse(many)] == [b"abc"] * 5 and list(warc.parse(gzip.compress(b""))) == []
    big = b"WARC/1.1\r\nContent-Length: 5000000\r\n\r\n" + b"x" * 5_000_000 + b"\r\n\r\n"
    assert [len(b) for _, b in warc.parse(gzip.compress(big) + gzip.compress(record))] == [5_000_000, 3]
    for bad in (record[:-2], record.replace(b": 3", b": 4"), record.replace(b"WARC/1.1", b"HTTP/1.1"), record.replace(b": 3", b": 30")):
        with pytest.raises(warc.WarcError):
            list(warc.parse(gzip.compress(bad)))


def test_a_changed_payload_ends_the_job(spark, pages, tmp_path):
    folder = Path(tmp_path, "w")
    warc.write(pages.where("page_id = 12").coalesce(1), f"file://{folder}")
    file = next(f for f in folder.iterdir() if f.suffix == ".gz")
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"zzz", b"zzy", 1)))
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="payload digest"):
        warc.read(spark, f"file://{folder}").collect()


def test_empty(spark, pages, tmp_path):
    warc.write(pages.limit(0), f"file://{tmp_path}/w")
    assert warc.restore(warc.read(spark, f"file://{tmp_path}/w")).count() == 0
