"""WARC archives: written with Spark's text writer, read back by reassembling segments.

Writing. A page is an HTTP response in chunked transfer framing. A block of more than ``SEGMENT`` bytes is cut: the first
piece is the ``response`` record, the others are ``continuation`` records that name its id as their origin and carry a
segment number, the last one with the total length. A page whose payload equals that of a page of smaller id becomes a
``revisit`` record that refers to it, so a payload is stored once.

Records end with two line ends, which is the line separator that the text writer is given; so its files are WARC
files, committed by Spark, and a lost executor costs its tasks only. Chunks are cut inside any text of the payload that
reads like a record's first line. So that line separates records and nothing else, and the text reader streams records
from files of any size.

Reading. Continuations are grouped by origin, ordered by segment number, their number and total length verified, and
the chunked framing is decoded. Payloads are checked against the digest of their record.

Defined results. No page_id: counts as greater than any other. No url: the record has no target. No html: an empty
payload, which is a payload like any other. Rows that repeat a page_id with an equal payload: one of them is the
response, the others revisit it. Rows that repeat a page_id with other payloads are judged by payload. No pages: no
records. Other columns of pages are left out. A page must fit in a task. Records that fail a check keep their row, with
``problem`` saying why and without a payload; a revisit of a record that isn't there has the problem ``target``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fits, forget_at_exit, scratch, scratch_dir, spread_join, table

VERSION = "WARC/1.1"
#: Most bytes of a block in one record, and of a chunk.
SEGMENT, CHUNK = 32 << 10, 8 << 10
#: Payloads of fewer bytes are all stored.
LEAST_BYTES = 0
#: When pages were fetched isn't known; a fixed date lets archives be written again alike.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Bytes of a row of ``_copies`` in memory.
COPY_BYTES = 160

_FIRST_LINE = re.compile(re.escape(VERSION.encode()))


# --- records as bytes


def chunked(payload: bytes) -> bytes:
    """``payload`` in chunks; each text like a record's first line is cut in two."""
    cuts = {0, len(payload), *range(0, len(payload), CHUNK), *(m.start() + 4 for m in _FIRST_LINE.finditer(payload))}
    at = sorted(cuts)
    return b"".join(b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(at, at[1:])) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body, trailers left out. ValueError if the framing is broken or cut off."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk")
        said = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", said):
            raise ValueError("chunk")
        size = int(said, 16)
        if not size:
            return b"".join(parts)
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("chunk")
        parts.append(body[end + 2 : at])
        at += 2


def _record(fields: dict[str, str | None], block: bytes) -> bytes:
    """A record without the two line ends after it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _urn(digest: str) -> str:
    """The id of the response with the payload of this SHA-256."""
    return f"<urn:uuid:{uuid.UUID(digest[:32])}>"


def _new_urn() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def page_records(page_id, url, sha1: str, payload: bytes | None, record_id: str, target: str | None, segment: int) -> Iterator[bytes]:
    """The records of a page: a revisit of ``target`` or else a response and its continuations."""
    fields = {
        "WARC-Type": "revisit" if target else "response",
        "WARC-Record-ID": record_id,
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(),
        "WARC-Page-ID": None if page_id is None else str(page_id),
    }
    if target:
        yield _record(fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": target}, b"")
        return
    block = HTTP + chunked(payload)
    fields["Content-Type"] = "application/http; msgtype=response"
    if len(block) <= segment:
        yield _record(fields, block)
        return
    yield _record(fields | {"WARC-Segment-Number": "1"}, block[:segment])
    for number, at in enumerate(range(segment, len(block), segment), 2):
        more = {
            "WARC-Type": "continuation",
            "WARC-Record-ID": _new_urn(),
            "WARC-Date": DATE,
            "WARC-Segment-Origin-ID": record_id,
            "WARC-Segment-Number": str(number),
            "WARC-Segment-Total-Length": str(len(block)) if at + segment >= len(block) else None,
        }
        yield _record(more, block[at : at + segment])


def parse_record(said: bytes) -> tuple[dict[str, str], bytes | None]:
    """(fields by lower-case name, block) of a record with or without its first line; no block where the
    length that the record states isn't that of what follows."""
    said = said.removeprefix(f"{VERSION}\r\n".encode())
    head, _, rest = said.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    stated = fields.get("content-length", "")
    if not stated.isdigit() or rest[int(stated) :].strip(b"\r\n"):
        return fields, None
    return fields, rest[: int(stated)] if len(rest) >= int(stated) else None


def response_payload(block: bytes) -> bytes:
    """The payload of an HTTP response. ValueError if it isn't one or its framing is broken."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        raise ValueError("http")
    coding = re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b""))
    return unchunked(body) if coding else body


# --- writing


def _copies(keyed: DataFrame, least_bytes: int) -> DataFrame:
    """By payload that more than one row has: ``n`` rows, ``first`` (least page_id) and how many rows (``ties``)
    have that. Reduced where the rows are, twice."""
    by_page = keyed.filter(F.octet_length("payload") >= least_bytes).groupBy("key", "page_id").agg(F.count(F.lit(1)).alias("c"))
    least = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "c")).alias("least")
    found = by_page.groupBy("key").agg(F.sum("c").alias("n"), least).filter("n > 1")
    return found.select("key", "n", F.col("least.page_id").alias("first"), F.col("least.c").alias("ties"))


def _judged(keyed: DataFrame, least_bytes: int) -> DataFrame:
    """``keyed`` with ``role``: alone (has no copies), response (has copies) or revisit; revisits without payload."""
    copies = scratch(_copies(keyed, least_bytes), "copies")
    counts = copies.agg(F.sum("n").alias("n"), F.max("ties").alias("ties")).first()
    if not counts["n"]:
        return keyed.withColumn("role", F.lit("alone"))
    if fits(copies, F.lit(COPY_BYTES)):
        met = keyed.join(F.broadcast(copies.drop("n")), "key", "left")
    else:
        met = spread_join(keyed, copies, "key", counts["n"], how="left")
    first = F.col("page_id").eqNullSafe(F.col("first"))
    role = F.when(F.col("ties").isNull(), "alone").when(~first, "revisit").when(F.col("ties") == 1, "response").otherwise("tied")
    met = met.withColumn("role", role).drop("first", "ties")
    bare = F.when(F.col("role") != "revisit", F.col("payload")).alias("payload")
    columns = ["page_id", "url", "sha1", "key", bare, "role"]
    if counts["ties"] == 1:
        return met.select(*columns)
    # Equal rows of the least page_id: one of each task, then one of those, is the response.
    here = Window.partitionBy("key", "_task").orderBy("url")
    tied = met.filter("role = 'tied'").withColumn("_task", F.spark_partition_id()).withColumn("_rank", F.row_number().over(here))
    tied = scratch(tied.withColumn("payload", F.when(F.col("_rank") == 1, F.col("payload"))), "tied")
    one = tied.filter("_rank = 1").withColumn("_rank", F.row_number().over(Window.partitionBy("key").orderBy("url", "_task")))
    judged = one.unionByName(tied.filter("_rank > 1")).withColumn("role", F.when(F.col("_rank") == 1, "response").otherwise("revisit"))
    return met.filter("role <> 'tied'").select(*columns).unionByName(judged.select(*columns))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, segment: int = SEGMENT) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files, compressed, to the folder ``path``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload"))
    keyed = keyed.withColumns({"key": F.sha2("payload", 256), "sha1": F.sha1("payload")})

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = {"WARC-Type": "warcinfo", "WARC-Record-ID": _new_urn(), "WARC-Date": DATE, "Content-Type": "application/warc-fields"}
        found, size = [_record(info, b"format: WARC File Format 1.1\r\n")], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "sha1", "payload", "key", "role"))):
                page_id, url, sha1, body, key, role = (x.as_py() for x in row)
                named = _urn(key) if role != "alone" else None
                for r in page_records(page_id, url, sha1, body, named if role == "response" else _new_urn(), named if role == "revisit" else None, segment):
                    found.append(r)
                    size += len(r)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["value"])
                    found, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["value"])

    made = _judged(keyed, least_bytes).mapInArrow(records, "value binary").select(F.col("value").cast("string"))
    made.write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


# --- reading

RECORDS = "record_id string, record_type string, page_id long, url string, payload_digest string, target string, segment int, total long, origin string, block binary, problem string"
PAGES = "record_id string, record_type string, page_id long, url string, payload_digest string, target string, payload_bytes long, payload binary, problem string"


def _number(said: str | None) -> int | None:
    return int(said) if said and re.fullmatch(r"-?\d{1,18}|-?\d{19}", said) and -(1 << 63) <= int(said) < 1 << 63 else None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("target", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("origin", pa.string()), ("block", pa.binary()), ("problem", pa.string())])
    for batch in batches:
        rows = []
        for said in batch.column("value"):
            fields, block = parse_record(said.as_py())
            kind = fields.get("warc-type")
            if kind not in ("response", "revisit", "continuation"):
                continue
            number = _number(fields.get("warc-segment-number"))
            rows.append(
                (
                    fields.get("warc-record-id"), kind, _number(fields.get("warc-page-id")), fields.get("warc-target-uri"),
                    fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, fields.get("warc-refers-to"),
                    number if number is None or 0 < number < 1 << 31 else -1, _number(fields.get("warc-segment-total-length")),
                    fields.get("warc-segment-origin-id"), block, "length" if block is None else None,
                )
            )
        columns = list(zip(*rows)) or [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)


def assembled(segments: list[dict]) -> bytes:
    """The block of a record's segments, in order of their numbers. ValueError if one lacks or is there
    twice, or if the lengths don't add up to the total that the last one states."""
    if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)) or any(s["block"] is None for s in segments):
        raise ValueError("segments")
    block = b"".join(s["block"] for s in segments)
    if segments[-1]["total"] != len(block) or any(s["total"] is not None for s in segments[:-1]):
        raise ValueError("total")
    return block


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each response or revisit in the WARC files at ``path``: record_id, record_type, page_id, url,
    payload_digest and payload_bytes (of the payload read back; for a revisit what its record states, and no
    length), target (record id that a revisit refers to), payload (null without ``payloads``), problem."""
    lines = spark.read.option("lineSep", f"\n{VERSION}\r\n").text(path).select(F.col("value").cast("binary").alias("value"))
    records = lines.mapInArrow(_parsed, RECORDS)
    segmented = F.col("segment").isNotNull() | F.col("origin").isNotNull()
    part = F.struct(F.coalesce("segment", F.lit(-1)).alias("segment"), "total", "block").alias("part")
    about = ["record_type", "page_id", "url", "payload_digest", "target", "problem"]
    whole = records.filter(~segmented).select("record_id", *about, F.lit(False).alias("cut"), F.array(part).alias("parts"))
    grouped = (
        records.filter(segmented)
        .withColumns({"record_id": F.coalesce("origin", "record_id"), "part": part, "first": F.when(F.col("origin").isNull(), F.struct(*about))})
        .groupBy("record_id")
        .agg(F.max("first").alias("first"), F.sort_array(F.collect_list("part")).alias("parts"))
        .select("record_id", "first.*", F.lit(True).alias("cut"), "parts")
        .withColumn("record_type", F.coalesce("record_type", F.lit("response")))
    )

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "page_id", "url", "payload_digest", "target"]
        for batch in batches:
            digests, sizes, bodies, problems = [], [], [], []
            for kind, stated, problem, cut, parts in zip(*(batch.column(c) for c in ("record_type", "payload_digest", "problem", "cut", "parts"))):
                stated, problem, body = stated.as_py(), problem.as_py(), None
                if problem is None and kind.as_py() == "response":
                    try:
                        body = response_payload(assembled(parts.as_py()) if cut.as_py() else parts.as_py()[0]["block"])
                        found = base64.b32encode(hashlib.sha1(body).digest()).decode()
                        if stated not in (None, found):
                            raise ValueError("digest")
                        stated = found
                    except ValueError as e:
                        problem, body = str(e), None
                digests.append(stated)
                sizes.append(None if body is None else len(body))
                bodies.append(body if payloads else None)
                problems.append(problem)
            kept = [batch.column(c) for c in names]
            kept[4] = pa.array(digests, pa.string())
            made = [pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary()), pa.array(problems, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*names, "payload_bytes", "payload", "problem"])

    return whole.unionByName(grouped).mapInArrow(decoded, PAGES)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` of ``read_archives`` with refers_to (page_id of the response that a revisit names), whose length
    the revisit gets. A target of many revisits is sent to where they are. Its digest must be theirs."""
    revisits = records.filter("record_type = 'revisit'")
    counts = revisits.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    found = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"), F.lit(True).alias("_there")
    )
    named = counts.join(found.dropDuplicates(["target"]), "target")
    total = revisits.count()
    met = spread_join(revisits, named, "target", total, how="left", row_bytes=F.lit(COPY_BYTES))
    missing = F.col("_there").isNull() | ~F.col("_digest").eqNullSafe(F.col("payload_digest"))
    met = met.withColumns({"payload_bytes": F.col("_bytes"), "problem": F.when(missing, "target").otherwise(F.col("problem"))})
    responses = records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return responses.unionByName(met.select(*responses.columns))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives in the shared folder and read back from them."""
    path = f"{scratch_dir(spark)}/plenaria/warc-{uuid.uuid4().hex}"
    forget_at_exit(spark, path)
    write_archives(table(spark, sf_dir, "pages", even=True), path)
    records = scratch(read_archives(spark, path, payloads=False).drop("payload"), "records")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT *, unhex(sha1(body)) AS h, count(*) OVER (PARTITION BY body) AS n,
  row_number() OVER (PARTITION BY body ORDER BY page_id NULLS LAST) AS r, first(page_id) OVER (PARTITION BY body ORDER BY page_id NULLS LAST) AS f FROM p),
bits AS (SELECT *, list_transform(range(0, 20), lambda i: CAST(('0x' || substr(hex(h), 2 * i + 1, 2)) AS INTEGER)) AS b FROM d)
SELECT page_id, strlen(body) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((((b[(5 * k) // 8 + 1] * 256 + coalesce(b[(5 * k) // 8 + 2], 0)) >> (11 - (5 * k) % 8)) & 31) + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN r > 1 THEN f END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM bits
"""
