"""TEI transcripts of debates as raw documents.

Files are found and read by Spark's binary-file source, one task per group of files. Their XML is
mixed content, whose order of text Spark's XML source does not keep, so a file is parsed in Python
into utterance rows with what they refer to; the rest (defaults, dates, names, filters) is native.
A file that cannot be parsed gives one row with an error and does not fail the job.
"""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.scalar import flexible_date, subcorpus, without_hashes
from .base import existing

TEI = "{http://www.tei-c.org/ns/1.0}"
XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
_FIELDS = (
    "path", "error", "session_id", "when", "language", "target", "who", "text", "utterance_id", "name", "role",
    "party_id", "party_name",
)
PARSED = T.StructType([T.StructField(f, T.StringType()) for f in _FIELDS] + [T.StructField("ordinal", T.LongType())])


def _first(element: ET.Element, *names: str) -> ET.Element | None:
    """The first descendant ``names[0]`` that leads to children named by the rest."""
    return element.find(".//" + "/".join(TEI + n for n in names))


def _people(header: ET.Element) -> dict[str, tuple[str, str, str]]:
    """(name, role, party reference) by person id."""
    listed = _first(header, "particDesc", "listPerson")
    found = {}
    for person in listed.iter(f"{TEI}person") if listed is not None else ():
        key = person.get(XML_ID)
        if not key:
            continue
        called = person.find(f"{TEI}persName")
        name = ""
        if called is not None:
            name = " ".join([called.findtext(f"{TEI}forename", ""), called.findtext(f"{TEI}surname", "")]).strip()
        refs = (
            a.get("ref", "").lstrip("#") for a in person.iter(f"{TEI}affiliation") if a.get("role") in ("member", "memberOf")
        )
        role = person.findtext(f".//{TEI}roleName", "MP")
        found[key] = (name or "Unknown", role, next((r for r in refs if r), "Unknown"))
    return found


def _parties(header: ET.Element) -> dict[str, str]:
    listed = _first(header, "particDesc", "listOrg")
    orgs = listed.iter(f"{TEI}org") if listed is not None else ()
    return {o.get(XML_ID): (o.findtext(f"{TEI}orgName", "").strip() or o.get(XML_ID)) for o in orgs if o.get(XML_ID)}


def _said(u: ET.Element) -> str:
    segments = u.findall(f".//{TEI}seg")
    return " ".join("".join(s.itertext()).strip() for s in segments or [u]).strip()


def parse_file(path: str, content: bytes) -> Iterator[dict]:
    """Utterance rows of one file, or one row with its ``error``; none if it is no transcript."""
    try:
        root = ET.fromstring(content)
    except (ET.ParseError, ValueError, LookupError) as e:
        yield {"path": path, "error": str(e)}
        return
    header = root.find(f"{TEI}teiHeader")
    body = _first(root, "body")
    if root.tag.rpartition("}")[2] not in ("TEI", "teiCorpus") or header is None or body is None:
        return
    stem = os.path.splitext(os.path.basename(unquote(urlsplit(path).path)))[0]
    title = _first(header, "titleStmt")
    meeting = _first(title, "meeting") if title is not None else None
    date = _first(header, "settingDesc", "setting", "date")
    language = _first(header, "langUsage", "language")
    category = _first(header, "textClass", "catRef")
    shared = {
        "path": path,
        "session_id": (meeting.get("n") if meeting is not None else None) or stem,
        "when": (date.get("when") or date.get(XML_ID)) if date is not None else None,
        "language": language.get("ident", "unk") if language is not None else "unk",
        "target": category.get("target") if category is not None else None,
    }
    people, parties = _people(header), _parties(header)
    for ordinal, u in enumerate(body.iter(f"{TEI}u")):
        who = u.get("who", "").lstrip("#")
        name, role, party = people.get(who, (who, "MP", "Unknown"))
        yield shared | {
            "who": who, "text": _said(u), "utterance_id": u.get(XML_ID), "name": name, "role": role, "party_id": party,
            "party_name": parties.get(party), "ordinal": ordinal,
        }


_BINARY = "path string, modificationTime timestamp, length long, content binary"
_ARROW = pa.schema([(f, pa.string()) for f in _FIELDS] + [("ordinal", pa.int64())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows = list(parse_file(path.as_py(), content.as_py() or b""))
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist(rows[at : at + 1000], schema=_ARROW)


class Utterances:
    """``utterances(path, content)`` for SQL: the rows of one file, to be joined laterally with files."""

    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        for row in parse_file(path or "", bytes(content or b"")):
            yield tuple(row.get(f) for f in _ARROW.names)


def register(spark: SparkSession, name: str = "utterances") -> None:
    """Make the table function known to the session's SQL."""
    spark.udtf.register(name, F.udtf(Utterances, returnType=PARSED))


def parse(files: DataFrame) -> DataFrame:
    """Utterances of ``files`` (path, content)."""
    return files.select("path", "content").mapInArrow(_parse, PARSED)


def documents(
    parsed: DataFrame, country: str, min_tokens: int = 20, subcorpora: Sequence[str] | None = None,
    default_date: str | None = None, trace: bool = False,
) -> DataFrame:
    """Parsed utterances as raw documents. Those without a speaker or with under ``min_tokens`` words are
    left out. ``subcorpora`` keeps only those named (upper case). An unreadable date is ``default_date``
    or null. trace: also ``_file`` and ``_ordinal``, the order of writing."""
    tokens = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    rows = parsed.filter("error IS NULL AND who <> ''").withColumn("token_count", tokens).filter(F.col("token_count") >= min_tokens)
    rows = rows.withColumn("subcorpus", subcorpus(F.col("target")))
    if subcorpora:
        rows = rows.filter(F.col("subcorpus").isin(list(subcorpora)))
    speech = F.concat_ws("_", "session_id", "who", F.col("ordinal").cast("string"))
    columns = {
        "doc_id": F.coalesce(F.nullif("utterance_id", F.lit("")), speech),
        "source": F.lit("parlamint"),
        "country_code": F.lit(country.upper()),
        "language": F.col("language"),
        "text": F.col("text"),
        "speaker_id": without_hashes(F.col("who")),
        "speaker_name": F.col("name"),
        "party": F.coalesce("party_name", "party_id"),
        "role": F.col("role"),
        "date": F.coalesce(flexible_date(F.col("when")), F.lit(default_date).cast("date")),
        "session_id": F.col("session_id"),
        "subcorpus": F.col("subcorpus"),
        "metadata": F.create_map(F.lit("token_count"), F.col("token_count").cast("string")),
        "token_count": F.col("token_count"),
    }
    if trace:
        columns |= {"_file": F.col("path"), "_ordinal": F.col("ordinal")}
    return rows.select(*(c.alias(n) for n, c in columns.items()))


class TranscriptSource:
    """All ``*.xml`` below a folder but corpus roots (``*-root.xml``, ``*_root.xml``)."""

    source_name = "parlamint"

    def __init__(self, country: str, min_tokens: int = 20, subcorpora: Sequence[str] | None = None, default_date: str | None = None):
        self.country, self.min_tokens, self.subcorpora, self.default_date = country.upper(), min_tokens, subcorpora, default_date

    def schema(self) -> T.StructType:
        return schemas.RAW_DOCUMENT

    def files(self, spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
        """(path, content) of the transcripts below ``path``; as a stream, of those that its checkpoint lacks."""
        reader = (spark.readStream.schema(_BINARY) if stream else spark.read).format("binaryFile")
        found = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(existing(spark, path))
        return found.filter(~F.col("path").rlike(r"[-_]root\.xml$")).select("path", "content")

    def paths(self, spark: SparkSession, path: str) -> DataFrame:
        """(path) of the transcripts below ``path``, in order; contents aren't read."""
        return self.files(spark, path).select("path").orderBy("path")

    def parsed(self, spark: SparkSession, path: str) -> DataFrame:
        return parse(self.files(spark, path))

    def documents(self, files: DataFrame, trace: bool = False) -> DataFrame:
        """Raw documents of ``files`` (path, content), be they of a table or of a stream."""
        return documents(parse(files), self.country, self.min_tokens, self.subcorpora, self.default_date, trace)

    def load(self, spark: SparkSession, path: str, trace: bool = False) -> DataFrame:
        return documents(self.parsed(spark, path), self.country, self.min_tokens, self.subcorpora, self.default_date, trace)

    def errors(self, spark: SparkSession, path: str) -> DataFrame:
        """(path, error) of files that could not be parsed."""
        return self.parsed(spark, path).filter("error IS NOT NULL").select("path", "error")
