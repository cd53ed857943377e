"""Keyed merges and the graph writer: idempotent upserts of node and edge tables.

A merge returns the new state of a table, or what is to be added to it. ``GraphStore`` keeps each table as
Parquet parts below a folder, and names the parts of all tables in one numbered manifest. Parts are
written whole, their keys checked, and then the next manifest is put in place by one rename: a reader
sees the old state of all tables or the new one, a failed write changes nothing, and of two writers one
is refused, where a rename is atomic and doesn't replace (HDFS, local disks); on object stores let one writer write. Small changes add small parts; ``compact`` joins them.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.scalar import entity_id, party_id, relation_name
from ..storage import drop, scratch, work_dir


def first_of(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in ``order``, nulls being least: an aggregate, so that rows of a
    frequent key are reduced where they are."""
    row, by = F.struct(*df.columns), F.struct(*order)
    found = df.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)))
    return found.agg((F.max_by(row, by) if last else F.min_by(row, by)).alias("_row")).select("_row.*")


def fresh_rows(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key of ``new`` that ``existing`` lacks. Rows that are all key need no order."""
    lacking = new.join(existing.select(*keys), keys, "left_anti")
    if set(existing.columns) == set(keys):
        return lacking.select(*existing.columns).distinct()
    return first_of(lacking, keys, order).select(*existing.columns)


def first_writer(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``existing`` and those rows of ``new`` whose key it lacks, the first of each; order columns go."""
    return existing.unionByName(fresh_rows(existing, new, keys, order))


def last_writer(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str], overwrite: list[str]) -> DataFrame:
    """The last row of each key of ``new`` sets the columns ``overwrite`` of an existing row, or is
    added whole where there is none."""
    latest = first_of(new, keys, order, last=True).select(*existing.columns)
    old = existing.select(*keys, F.struct(*existing.columns).alias("_old"))
    new = latest.select(*keys, F.struct(*existing.columns).alias("_new"))

    def value(c: str):
        if c in keys:
            return F.col(c)
        if c in overwrite:
            return F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)
        return F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")).alias(c)

    return old.join(new, keys, "full_outer").select(*(value(c) for c in existing.columns))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has: empty where the key constraint holds."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def speech_rows(documents: DataFrame, text_cap: int | None = None) -> DataFrame:
    """Raw documents as speech nodes: midnight of the date, words as counted, the text or so many characters of it."""
    absent = {f.name: F.lit(None).cast(f.dataType) for f in schemas.SPEECHES.fields}
    columns = absent | {
        "speech_id": F.col("doc_id"),
        "session_id": F.col("session_id"),
        "date": F.col("date"),
        "timestamp": F.col("date").cast("timestamp"),
        "year": F.year("date"),
        "language": F.col("language"),
        "country_code": F.col("country_code"),
        "party": F.col("party"),
        "subcorpus": F.col("subcorpus"),
        "word_count": F.col("token_count"),
        "raw_text": F.col("text") if text_cap is None else F.substring("text", 1, text_cap),
    }
    return documents.select(*(c.alias(n) for n, c in columns.items()), *(c for c in ("_file", "_ordinal") if c in documents.columns))


def ingest_rows(documents: DataFrame, text_cap: int | None = None) -> dict[str, DataFrame]:
    """Node and edge rows that a set of raw documents states, by table."""
    seq = [c for c in ("_file", "_ordinal") if c in documents.columns]
    people = F.col("speaker_id").alias("politician_id")
    party = party_id(F.col("country_code"), F.col("party")).alias("party_id")
    null = F.lit(None).cast("string")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    speech = F.col("doc_id").alias("speech_id")
    return {
        "speeches": speech_rows(documents, text_cap),
        "politicians": documents.select(people, F.col("speaker_name").alias("name"), "party", "country_code", "role", empty.alias("social_media_handles"), *seq),
        "parties": documents.select(party, F.col("party").alias("name"), "country_code", null.alias("abbreviation"), null.alias("political_family"), *seq),
        "sessions": documents.select("session_id", "country_code", "date", *seq),
        "member_of": documents.select(people, party, *seq),
        "delivered_speech": documents.select(people, speech, "date", *seq),
        "part_of_session": documents.select(speech, "session_id", *seq),
    }


METRIC_COLUMNS = ("ttr", "flesch_kincaid_grade", "avg_sentence_length", "gunning_fog")


def metric_rows(results: DataFrame) -> DataFrame:
    """(speech_id, sentiment_score and metrics) of extraction results, one row each: of rows that repeat an
    id, the one that is least when written as JSON."""
    row = F.struct(F.col("sentiment_score"), *(F.try_element_at("complexity_metrics", F.lit(m)).alias(m) for m in METRIC_COLUMNS))
    one = results.groupBy(F.col("doc_id").alias("speech_id")).agg(F.min_by(row, F.to_json(row)).alias("_r"))
    return one.select("speech_id", "_r.*")


def with_metrics(speeches: DataFrame, results: DataFrame) -> DataFrame:
    """Sentiment and metrics of extraction results set on the speeches they name; null clears, other
    results and other speeches stay as they are."""
    return _set(speeches, metric_rows(results), ("sentiment_score", *METRIC_COLUMNS))


def _set(speeches: DataFrame, rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``speeches`` with ``columns`` of those that ``rows`` name, one row each."""
    update = rows.select("speech_id", F.struct(*columns).alias("_new"))
    changed = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}
    return speeches.join(update, "speech_id", "left").withColumns(changed).select(*speeches.columns)


def extraction_rows(results: DataFrame) -> dict[str, DataFrame]:
    """Topic, entity and concept nodes, and their edges, that extraction results state."""
    speech = F.col("doc_id").alias("speech_id")
    topics = results.select(speech, F.posexplode("topics").alias("_ordinal", "t"))
    entities = results.select(speech, F.posexplode("named_entities").alias("_ordinal", "e"))
    triples = results.select(speech, F.explode("triples").alias("t"))
    relation = relation_name(F.col("t.relation"))
    return {
        "topics": topics.select(F.col("t.label").alias("label"), F.col("t.keywords").alias("keywords"), F.lit("multilingual").alias("language"), F.col("speech_id").alias("_file"), "_ordinal"),
        "entities": entities.select(entity_id(F.col("e.label"), F.col("e.text")).alias("entity_id"), F.col("e.text").alias("text"), F.col("e.label").alias("label"), F.lit(None).cast("string").alias("canonical_text"), F.col("speech_id").alias("_file"), "_ordinal"),
        "concepts": triples.select(F.explode(F.array("t.subject", "t.obj")).alias("text")),
        "mentions_topic": topics.select("speech_id", F.col("t.label").alias("topic")),
        "references_entity": entities.select("speech_id", entity_id(F.col("e.label"), F.col("e.text")).alias("entity_id"), F.col("e.score").alias("score")),
        "contains_triple": triples.select("speech_id", F.col("t.subject").alias("subject")),
        "semantic_relation": triples.select(F.col("t.subject").alias("subject"), F.col("t.obj").alias("obj"), relation.alias("relation"), "speech_id"),
    }


class ConcurrentWrite(RuntimeError):
    """Another writer has put the next manifest in place."""


#: What extraction sets on speeches: kept beside them and laid over them when they are read.
UPDATES = T.StructType([f for f in schemas.SPEECHES.fields if f.name in ("speech_id", "sentiment_score", *METRIC_COLUMNS)])
#: Tables whose parts hold later states of the same keys; the last one counts.
LATER = {"embeddings": ["doc_id"], "speech_updates": ["speech_id"]}
#: Tables whose parts are folders by these columns, so that a read for some values lists no others.
FOLDERS = {"embeddings": ["country_code", "year"]}
#: Parts of a table from which on a write joins them.
MOST_PARTS = 64


class GraphStore:
    """Tables of the graph below a folder that driver and executors share. text_cap: characters of a speech's text that
    are kept (10,000 for the tables that the queries were first made for), None: all."""

    def __init__(self, spark: SparkSession, path: str, text_cap: int | None = None):
        self.spark, self.path, self.text_cap = spark, path.rstrip("/"), text_cap

    def __enter__(self) -> GraphStore:
        return self

    def __exit__(self, *_: object) -> None:
        return None

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def manifests(self) -> list[int]:
        """Numbers of the manifests that there are, in order."""
        fs, folder = self._fs(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def _manifest(self, number: int | None = None) -> tuple[int, dict[str, list[str]]]:
        """(number, parts by table) of a manifest, by default the last one."""
        if number is None:
            number = max(self.manifests(), default=0)
        if not number:
            return 0, {}
        rows = self.spark.read.text(f"{self.path}/manifests/{number:012d}.json", wholetext=True).first()
        return number, json.loads(rows[0])

    def _schema(self, name: str) -> T.StructType:
        schema = UPDATES if name == "speech_updates" else schemas.GRAPH[name][0]
        later = [T.StructField("_seq", T.LongType())] if name in LATER else []
        return T.StructType([*(T.StructField(f.name, f.dataType) for f in schema.fields), *later])

    def _stored(self, name: str, where: dict | None = None) -> DataFrame:
        parts = self._manifest()[1].get(name, [])
        schema = self._schema(name)
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = self._parts(name, parts)
        for column, value in (where or {}).items():
            rows = rows.filter(F.col(column) == value)
        if name == "embeddings":  # a document that has moved leaves a row without a vector where it was
            rows = rows.withColumn("_real", F.col("vector").isNotNull())
            return first_of(rows, LATER[name], ["_seq", "_real"], last=True).filter("_real").drop("_real")
        return first_of(rows, LATER[name], ["_seq"], last=True) if name in LATER else rows

    def _parts(self, name: str, parts: list[str]) -> DataFrame:
        schema = self._schema(name)
        reader = self.spark.read.schema(schema)
        if name in FOLDERS:  # parts are folders of one more level, so that all are read as one table
            reader = reader.option("basePath", f"{self.path}/{name}")
        return reader.parquet(*(f"{self.path}/{name}/{p}" for p in parts)).select(*schema.names)

    @staticmethod
    def _new_part(name: str) -> str:
        return f"part=p-{uuid.uuid4().hex}" if name in FOLDERS else f"p-{uuid.uuid4().hex}"

    def read(self, name: str) -> DataFrame:
        """The table's state; speeches with what later steps have set on them."""
        rows = self._stored(name)
        if name == "speeches":
            parts = self._manifest()[1]
            if parts.get("speech_updates"):
                rows = _set(rows, self._stored("speech_updates"), ("sentiment_score", *METRIC_COLUMNS))
            if parts.get("embeddings"):
                vectors = self._stored("embeddings").select(F.col("doc_id").alias("speech_id"), F.col("vector").alias("embedding"), F.col("model_name").alias("embedding_model"))
                rows = _set(rows, vectors, ("embedding", "embedding_model"))
        return rows.drop("_seq")

    def write(self, tables: dict[str, DataFrame], add: bool = False, fresh: bool = False) -> None:
        """Make each DataFrame the table's new state or, with ``add``, a part of it. All of it shows at once. A key may be
        there once, in all parts together; ``fresh`` says that the rows' keys aren't in the other parts."""
        number, parts = self._manifest()
        new = {}
        for name, df in tables.items():
            part, schema = self._new_part(name), self._schema(name)
            if name in LATER:
                df = df.withColumn("_seq", F.lit(number + 1).cast("long"))
            df.select(*schema.names).write.partitionBy(*FOLDERS.get(name, [])).parquet(f"{self.path}/{name}/{part}")
            written = self._parts(name, [part])
            keys = (LATER.get(name) or schemas.GRAPH[name][1]) + FOLDERS.get(name, [])
            clash = duplicate_keys(written, keys).first()
            others = parts.get(name, []) if add and not fresh and name not in LATER else []
            if clash is None and others:
                there = self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}/{p}" for p in others)).select(*keys)
                clash = written.select(*keys).join(there, keys, "left_semi").first()
            if clash is not None:
                raise ValueError(f"{name}: more than one row of key {clash.asDict()}")
            if not add:
                new[name] = [part]
            elif written.isEmpty():
                new[name] = parts.get(name, [])
            else:
                new[name] = [*parts.get(name, []), part]
        self._commit(number + 1, parts | new)
        for name in tables:
            if len(new[name]) > MOST_PARTS:
                self.compact(name)

    def _commit(self, number: int, parts: dict[str, list[str]]) -> None:
        fs, target = self._fs(f"{self.path}/manifests/{number:012d}.json")
        _, written = self._fs(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = fs.create(written, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(written, target):
            fs.delete(written, False)
            raise ConcurrentWrite(f"manifest {number} is there already")

    def compact(self, name: str) -> None:
        """Join the parts of a table, and delete what neither the last manifest nor the one before names."""
        number, parts = self._manifest()
        rows, part = self._stored(name), self._new_part(name)
        rows.write.partitionBy(*FOLDERS.get(name, [])).parquet(f"{self.path}/{name}/{part}")
        self._commit(number + 1, parts | {name: [part]})
        keep = {p for n in (number, number + 1) for p in (self._manifest(n)[1].get(name, []) if n else [])}
        fs, folder = self._fs(f"{self.path}/{name}")
        for status in fs.listStatus(folder):
            if status.getPath().getName() not in keep:
                fs.delete(status.getPath(), True)

    def _fresh(self, rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
        found = {}
        for name, new in rows.items():
            keys = schemas.GRAPH[name][1]
            order = [c for c in ("_file", "_ordinal") if c in new.columns] or keys
            found[name] = fresh_rows(self._stored(name), new, keys, order)
        return found

    def upsert_documents(self, documents: DataFrame) -> None:
        """First writer wins on every node and edge that ``documents`` state; only new ones are written."""
        self.write(self._fresh(ingest_rows(documents, self.text_cap)), add=True, fresh=True)

    def upsert_politicians(self, rows: DataFrame, order: list[str]) -> None:
        """Name, party and role are the last writer's; country and handles the first's."""
        merged = last_writer(self.read("politicians"), rows, ["politician_id"], order, ["name", "party", "role"])
        self.write({"politicians": merged})

    def upsert_parties(self, rows: DataFrame, order: list[str]) -> None:
        """The name is the last writer's."""
        self.write({"parties": last_writer(self.read("parties"), rows, ["party_id"], order, ["name"])})

    def upsert_extractions(self, results: DataFrame) -> None:
        """Metrics on speeches, and the nodes and edges of topics, entities and triples. Results that
        name no speech of the store are left out; only what is new or set is written. ``results`` are evaluated
        once: all eight tables are made of what was written of them then."""
        path = work_dir(self.spark, "results")
        try:
            ids = self._stored("speeches").select(F.col("speech_id").alias("doc_id"))
            results.select(*schemas.EXTRACTION.names).join(ids, "doc_id", "left_semi").write.parquet(path)
            known = self.spark.read.schema(schemas.EXTRACTION).parquet(path)
            rows = self._fresh(extraction_rows(known))
            self.write(rows | {"speech_updates": metric_rows(known)}, add=True, fresh=True)
        finally:
            drop(self.spark, path)

    def upsert_embeddings(self, records: DataFrame, order: list[str] | None = None) -> None:
        """The last vector of each document replaces the one before, here and on its speech. Vectors are of one
        dimension, that of the stored ones if there are any: else ValueError."""
        latest = scratch(first_of(records, ["doc_id"], order or ["model_name", "vector"], last=True), "vectors")
        sizes = latest.select(F.size("vector").alias("n")).distinct()
        there = self._manifest()[1].get("embeddings", [])
        if there:
            old = self._stored("embeddings")
            sizes = sizes.union(old.select(F.size("vector")).limit(1)).distinct()
            was = old.select("doc_id", F.struct(*FOLDERS["embeddings"]).alias("_was"))
            moved = latest.join(was, "doc_id").filter(~F.struct(*FOLDERS["embeddings"]).eqNullSafe(F.col("_was")))
            moved = moved.select("doc_id", "_was.*").withColumns({f.name: F.lit(None).cast(f.dataType) for f in schemas.EMBEDDINGS.fields if f.name not in ("doc_id", *FOLDERS["embeddings"])})
            latest = latest.unionByName(moved, allowMissingColumns=True)
        dims = [r["n"] for r in sizes.filter("n >= 0").limit(2).collect()]
        if len(dims) > 1:
            raise ValueError(f"vectors of {min(dims)} and of {max(dims)} dimensions")
        self.write({"embeddings": latest}, add=True)

    def vectors(self, country: str, year: int | None = None) -> DataFrame:
        """Embedding records of a country, and year: folders of others aren't listed, as long as the table is."""
        return self._stored("embeddings", {"country_code": country} | ({} if year is None else {"year": year})).drop("_seq")

    def recreate(self, name: str) -> None:
        """Make the table an empty one; its parts go when it is next compacted."""
        number, parts = self._manifest()
        self._commit(number + 1, parts | {name: []})

    def unprocessed(self, processed: DataFrame, country: str) -> DataFrame:
        """Speeches of a country that ``processed`` (by speech_id) lacks."""
        own = self.read("speeches").filter(F.col("country_code") == country)
        return own.join(processed.select("speech_id"), "speech_id", "left_anti")

    def texts(self, ids: DataFrame) -> DataFrame:
        """(speech_id, raw_text) of the speeches that ``ids`` (speech_id) names."""
        return self._stored("speeches").select("speech_id", "raw_text").join(ids.select("speech_id"), "speech_id", "left_semi")
