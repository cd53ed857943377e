"""WARC archives: round trips, revisits by brute force, and archives of other writers."""

import base64
import gzip
import hashlib
import os

import pytest

from plenaria.llm import common, warc

PAGE = "page_id long, url string, html string"


def digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def written(spark, tmp_path, rows, schema=PAGE, **options):
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(rows, schema).repartition(3), path, **options)
    return path


def judged(rows, least=0):
    """(page_id, payload_bytes, digest, type, refers_to) of each row, sorted."""
    def last(i):
        return (i is None, i or 0)

    found, seen = [], {}
    for page_id, _, html in sorted(rows, key=lambda r: last(r[0])):
        body = (html or "").encode()
        kind, target = "response", None
        if len(body) >= least:
            if body in seen:
                kind, target = "revisit", seen[body]
            else:
                seen[body] = page_id
        found.append((page_id, len(body), digest(body), kind, target))
    return sorted(found, key=repr)


def read_back(spark, path):
    records = warc.resolved(warc.read_archives(spark, path))
    got = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem").collect()
    assert all(r.problem is None for r in got)
    return sorted((tuple(r)[:5] for r in got), key=repr)


ODD = [
    (1, "http://a.org/\r\nWARC/1.1\r\nx", "é" * 60_000),
    (2, None, None),
    (3, "http://a.org/", ""),
    (4, "", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\n"),
    (5, "u", "WARC/1.1\r\n" * 3_000),
    (6, "u", "0\r\n\r\n"),
    (7, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\n"),
    (8, "u", "same"), (8, "u", "same"), (8, "v", "same"), (9, "u", "same"), (8, "u", "other"),
    (None, "u", "same"), (None, "u", "nobody's"), (None, "u", "nobody's"),
    (-3, "u", "\n\nWARC/1.1"), (10, "u", "x" * 1_000_000), (11, "u", "x" * 1_000_000),
]


@pytest.mark.parametrize("segment", [7, 100, warc.SEGMENT])
def test_odd_pages_come_back(spark, tmp_path, segment):
    rows = [r for r in ODD if segment > 7 or len(r[2] or "") < 1000]
    path = written(spark, tmp_path, rows, segment=segment)
    assert read_back(spark, path) == judged(rows)
    bodies = {(r.page_id, bytes(r.payload)) for r in warc.read_archives(spark, path).filter("record_type = 'response'").collect()}
    assert bodies == {(i, next((h or "").encode() for j, _, h in rows if j == i and digest((h or "").encode()) == d)) for i, _, d, kind, _ in judged(rows) if kind == "response"}


def test_small_payloads_are_stored(spark, tmp_path):
    rows = [(i, "u", h) for i, h in enumerate(["", "", "abc", "abc", "abcd", "abcd"])]
    assert read_back(spark, written(spark, tmp_path, rows, least_bytes=4)) == judged(rows, 4)


def test_no_pages_and_other_columns(spark, tmp_path):
    assert read_back(spark, written(spark, tmp_path, [])) == []
    rows = [(1, "u", "a", "x", 1), (2, "u", "a", "y", 2)]
    path = str(tmp_path / "more")
    warc.write_archives(spark.createDataFrame(rows, PAGE + ", key string, n int"), path)
    assert read_back(spark, path) == judged([r[:3] for r in rows])


def test_a_third_of_rows_alike_and_no_broadcast(spark, tmp_path, monkeypatch):
    rows = [(i, "u", "copy" if i % 3 == 0 else f"page {i}") for i in range(900)] + [(i, "u", "copy") for i in (0, 0, 0, 3)]
    monkeypatch.setattr(warc, "fits", lambda *a: False)
    assert read_back(spark, written(spark, tmp_path, rows)) == judged(rows)


def test_all_pages(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    got = sorted((tuple(r)[:5] for r in warc.op11_warc(spark, sf).collect()), key=repr)
    assert got == judged(rows)


def test_files_are_archives_in_themselves(spark, tmp_path):
    """A reader that goes by lengths alone finds the same records."""
    path = written(spark, tmp_path, ODD, segment=5_000)
    kinds = []
    for name in os.listdir(path):
        if not name.endswith(".gz"):
            continue
        with gzip.open(f"{path}/{name}") as f:
            data = f.read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            kinds.append(fields["WARC-Type"])
            data = rest[n + 4 :]
    assert kinds.count("response") + kinds.count("revisit") == len(ODD)
    assert kinds.count("continuation") > 20 and kinds.count("warcinfo") >= 1


def record(fields, block, length=None):
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    whole = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nplain"
    framed = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n5;ext=1\r\nhello\r\n6\r\n world\r\n0\r\nTrailer: x\r\n\r\n"
    cut = {"WARC-Type": "continuation", "WARC-Segment-Origin-ID": "<o>"}
    first = [
        record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<i>"}, b"a: b"),
        record({"WARC-Type": "response", "WARC-Record-ID": "<p>"}, whole),
        record(cut | {"WARC-Record-ID": "<o3>", "WARC-Segment-Number": 3, "WARC-Segment-Total-Length": len(framed)}, framed[60:]),
        record({"WARC-Type": "response", "WARC-Record-ID": "<bad>", "WARC-Payload-Digest": "sha1:ABC"}, whole),
        record({"WARC-Type": "response", "WARC-Record-ID": "<long>"}, whole, 1000),
        record({"WARC-Type": "response", "WARC-Record-ID": "<http>"}, b"no response"),
        record({"WARC-Type": "response", "WARC-Record-ID": "<chunk>"}, framed[:-20]),
        record({"WARC-Type": "revisit", "WARC-Record-ID": "<lost>", "WARC-Refers-To": "<nowhere>"}, b""),
    ]
    second = [
        record({"WARC-Type": "response", "WARC-Record-ID": "<o>", "WARC-Segment-Number": 1}, framed[:30]),
        record(cut | {"WARC-Record-ID": "<o2>", "WARC-Segment-Number": 2}, framed[30:60]),
        record(cut | {"WARC-Segment-Origin-ID": "<q>", "WARC-Segment-Number": 2, "WARC-Segment-Total-Length": 9}, b"x"),
        record({"WARC-Type": "response", "WARC-Record-ID": "<t>", "WARC-Segment-Number": 1}, whole[:9]),
        record(cut | {"WARC-Segment-Origin-ID": "<t>", "WARC-Segment-Number": 2, "WARC-Segment-Total-Length": 8}, whole[9:]),
        record({"WARC-Type": "revisit", "WARC-Record-ID": "<r>", "WARC-Refers-To": "<p>", "WARC-Payload-Digest": f"sha1:{digest(b'plain')}"}, b""),
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.warc").write_bytes(b"".join(first))
    (tmp_path / "a/two.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in second))
    got = {r.record_id: r for r in warc.resolved(warc.read_archives(spark, str(tmp_path / "a"))).collect()}
    assert {k: bytes(r.payload) for k, r in got.items() if r.payload is not None} == {"<p>": b"plain", "<o>": b"hello world"}
    problems = {k: r.problem for k, r in got.items()}
    assert problems == {
        "<p>": None, "<o>": None, "<r>": None, "<bad>": "digest", "<long>": "length", "<http>": "http", "<chunk>": "chunk",
        "<lost>": "target", "<q>": "segments", "<t>": "total",
    }
    assert got["<r>"].payload_bytes == 5


def test_revisits_of_a_frequent_target(spark, tmp_path, monkeypatch):
    rows = [(i, "u", "copy") for i in range(50)] + [(i, "u", f"p{i}") for i in range(50, 60)]
    monkeypatch.setattr(common, "HOT_VALUES", 4)
    assert read_back(spark, written(spark, tmp_path, rows)) == judged(rows)
