"""Extraction of entities, topics, triples and sentiment, with pluggable backends.

A backend is asked for batches. Entities come from all texts; topics, triples and sentiment only
from texts of enough words, filtered out before the expensive backend sees them. The defaults are
deterministic rules that need no model: they keep the data flow testable and claim no quality.

Texts are passed whole. A backend with a context window has to take a text in parts and merge its
findings; only callers that ask for prefixes get them, by a number of characters.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import schemas
from ..functions.complexity import as_map, from_counts
from ..functions.textcounts import counted, DDL as COUNTED
from ..functions.scalar import relation_name, word_count

LABELS = ("PERSON", "ORGANIZATION", "LOCATION", "LAW_TREATY", "POLITICAL_PARTY", "EVENT")
LEAST_WORDS = 50
THRESHOLD = 0.5
RETRIES = 2


def _text(cap: int | None) -> Column:
    """The text, or its first ``cap`` characters."""
    return F.col("text") if cap is None else F.substring("text", 1, cap)


#: Rows of a batch that are worked on at once, so that what is made of them has a bound.
SLICE = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


class EntityBackend(Protocol):
    extractor_name: str

    def extract_batch(self, texts: list[str]) -> list[list[dict]]: ...


class ReplyBackend(Protocol):
    """Answers a text with JSON: topics, triples and a sentiment score."""

    extractor_name: str

    def reply(self, text: str, correction: str | None = None) -> str: ...


class RuleEntities:
    """Runs of capitalised words within a sentence; their label follows from key words in them."""

    extractor_name = "rules"
    _run = re.compile(r"[A-ZÀ-Þ](?<=[\w,;] [A-ZÀ-Þ])[\w-]+(?: [A-ZÀ-Þ][\w-]+)*")  # the letter first: a search goes from one to the next
    _keys = (
        ("LAW_TREATY", re.compile(r"\b(?:Act|Law|Treaty|Gesetz|Loi|Ley)\b")),
        ("POLITICAL_PARTY", re.compile(r"\b(?:Party|Partei|Parti|Partido)\b")),
        ("ORGANIZATION", re.compile(r"\b(?:Committee|Council|Union|Ministry|Commission|Ausschuss|Rat)\b")),
        ("EVENT", re.compile(r"\b(?:Summit|Election|Conference|Wahl)\b")),
    )

    def extract_batch(self, texts: list[str]) -> list[list[dict]]:
        return [[self._entity(m) for m in self._run.finditer(t)] for t in texts]

    def _entity(self, m: re.Match) -> dict:
        label = next((name for name, key in self._keys if key.search(m[0])), "PERSON" if " " in m[0] else "LOCATION")
        score = min(0.95, 0.6 + 0.1 * m[0].count(" "))
        return {"text": m[0], "label": label, "start": m.start(), "end": m.end(), "score": score}


#: What a backend finds in a text.
ENTITIES = "array<struct<text:string,label:string,start:int,end:int,score:double>>"


def _found(model: EntityBackend, texts: list[str]) -> pa.Array:
    """The entities of each text; of a batch that fails, text by text."""

    def one(text: str) -> list[dict]:
        try:
            return model.extract_batch([text])[0]
        except Exception:
            return []

    try:
        found = model.extract_batch(texts)
    except Exception:
        found = [one(t) for t in texts]
    return pa.array(found, to_arrow_type(schemas.EXTRACTION["named_entities"].dataType))


def entities(documents: DataFrame, backend: EntityBackend | None = None, threshold: float = THRESHOLD, cap: int | None = None) -> DataFrame:
    """(doc_id, named_entities): labels upper case, scores of 4 digits, those under ``threshold`` left
    out. A batch that fails is asked for text by text; a text that fails has none."""
    backend = shared(backend or RuleEntities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(backend)
        for batch in batches:
            found = _found(model, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "named_entities"])

    texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), _text(cap).alias("text"))
    return texts.mapInArrow(run, f"doc_id string, named_entities {ENTITIES}").withColumn("named_entities", _shaped(threshold))


def _shaped(threshold: float) -> Column:
    return F.transform(
        F.filter("named_entities", lambda e: e["score"] >= threshold),
        lambda e: F.struct(e["text"].alias("text"), F.upper(e["label"]).alias("label"), e["start"].alias("start"), e["end"].alias("end"), F.round(e["score"], 4).alias("score")),
    )


def reply_json(raw: Column) -> Column:
    """The outermost JSON object of a reply, without fences and what surrounds it; null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(raw, "```(?:json)?", ""), r"(?s)(\{.*\})", 1), F.lit(""))


def parsed_reply(raw: Column) -> Column:
    """A reply as a struct, null if invalid: no object, or a sentiment beyond -1 to 1. Topics need a label
    and triples a subject and an object; a missing sentiment is 0.0; relations are normalised. The JSON is read
    once a reply: what is made of it is made of a lambda's variable."""
    return F.get(F.transform(F.array(F.from_json(reply_json(raw), schemas.REPLY)), _checked_reply), F.lit(0))


def _checked_reply(data: Column) -> Column:
    score = F.coalesce(data["sentiment_score"], F.lit(0.0))
    some = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    topics = F.transform(
        F.filter(F.coalesce(data["topics"], F.array().cast(schemas.REPLY["topics"].dataType)), lambda t: some(t["label"])),
        lambda t: F.struct(t["label"].alias("label"), F.coalesce(t["keywords"], F.array().cast("array<string>")).alias("keywords")),
    )
    triples = F.transform(
        F.filter(F.coalesce(data["triples"], F.array().cast(schemas.REPLY["triples"].dataType)), lambda t: some(t["subject"]) & some(t["obj"])),
        lambda t: F.struct(
            t["subject"].alias("subject"),
            relation_name(t["relation"]).alias("relation"),
            t["obj"].alias("obj"),
            t["subject_type"].alias("subject_type"),
            t["obj_type"].alias("obj_type"),
        ),
    )
    return F.when(
        data.isNotNull() & score.between(-1, 1),
        F.struct(topics.alias("topics"), triples.alias("triples"), score.alias("sentiment_score")),
    )


class LexiconReplies:
    """Topics from frequent long words, sentiment from two short word lists, no triples but of "X is Y"."""

    extractor_name = "lexicon"
    _good = frozenset("good great success progress support welcome strong better".split())
    _bad = frozenset("bad poor failure crisis against wrong weak worse worthless".split())

    def reply(self, text: str, correction: str | None = None) -> str:
        import json
        from collections import Counter

        words = re.findall(r"[^\W\d_]+", text.lower())
        counts = Counter(words)
        top = heapq.nsmallest(3, (w for w in counts if len(w) > 5), key=lambda w: (-counts[w], w))
        good, bad = sum(counts[w] for w in self._good), sum(counts[w] for w in self._bad)
        triples = [{"subject": a, "relation": "is", "obj": b} for a, b in re.findall(r"\b(\w{4,}) is (\w{4,})\b", text)[:5]]
        score = (good - bad) / (good + bad) if good + bad else 0.0
        return json.dumps({"topics": [{"label": w, "keywords": [w]} for w in top], "triples": triples, "sentiment_score": score})


def _valid(raw: str) -> bool:
    """Whether ``parsed_reply`` takes it; used to decide on another try."""
    import json

    m = re.search(r"\{.*\}", re.sub(r"```(?:json)?", "", raw or ""), re.S)
    try:
        score = json.loads(m[0]).get("sentiment_score") or 0.0 if m else None
        return score is not None and -1 <= float(score) <= 1
    except (ValueError, TypeError, AttributeError):
        return False


def _asked(model: ReplyBackend, text: str) -> str | None:
    """The model's reply, the last one if none of its tries is valid, none if it fails."""
    raw, correction = None, None
    for _ in range(1 + RETRIES):
        try:
            raw = model.reply(text, correction)
        except Exception:
            return None
        if _valid(raw):
            return raw
        correction = f"Not a valid reply, answer with the JSON object only: {raw!r}"
    return raw


def replies(
    documents: DataFrame, backend: ReplyBackend | None = None, least_words: int = LEAST_WORDS, cap: int | None = None, prompt_cap: int | None = None
) -> DataFrame:
    """(doc_id, topics, triples, sentiment_score) of texts of ``least_words`` or more. An invalid reply is
    asked for again, at most RETRIES times, with what was wrong; any other failure is an empty result."""
    backend = shared(backend or LexiconReplies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(backend)
        for batch in batches:
            found = [_asked(model, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "raw"])

    rows = documents.filter(word_count(_text(cap)) >= least_words)
    texts = rows.select(F.col("doc_id").cast("string").alias("doc_id"), _text(prompt_cap).alias("text"))
    return texts.mapInArrow(run, "doc_id string, raw string").select("doc_id", parsed_reply(F.col("raw")).alias("_r")).select("doc_id", "_r.*")


def extract(
    documents: DataFrame, entity_backend: EntityBackend | None = None, reply_backend: ReplyBackend | None = None,
    llm: bool = True, least_words: int = LEAST_WORDS, threshold: float = THRESHOLD, cap: int | None = None, prompt_cap: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Extraction results of ``documents`` (doc_id, text), a row each: entities, then topics, triples and
    sentiment of those with enough words (llm=False: of none), and complexity metrics. keep: columns that stay.

    One pass without a shuffle: one task counts what the metrics are made of and asks both backends, a part of
    a batch at a time.
    """
    first, second = shared(entity_backend or RuleEntities), shared(reply_backend or LexiconReplies)
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), *keep, _text(cap).alias("text"))
    columns = ["doc_id", *keep]
    kept = rows.select(*columns).schema
    names = [*columns, "counts", "named_entities", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, answerer = loaded(first), loaded(second) if llm else None
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            counts = counted(batch.column("text"))
            found = _found(finder, [t or "" for t in texts])
            asked = [llm and t is not None and n >= least_words for t, n in zip(texts, counts.field("words").to_pylist(), strict=True)]
            raw = [_asked(answerer, t[:prompt_cap]) if ask else None for t, ask in zip(texts, asked, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), counts, found, pa.array(raw, pa.string())], names)

    schema = T.StructType([*kept.fields, *T.DataType.fromDDL(f"counts struct<{COUNTED}>, named_entities {ENTITIES}, raw string").fields])
    made = rows.mapInArrow(run, schema).withColumn("_r", parsed_reply(F.col("raw"))).withColumn("named_entities", _shaped(threshold))
    measured = from_counts(F.when(F.col("counts.words") > 0, F.col("counts")))
    empty = {c: F.array().cast(schemas.EXTRACTION[c].dataType) for c in ("topics", "triples")}
    return made.select(
        "doc_id", *keep, "named_entities", *(F.coalesce(F.col("_r")[c], e).alias(c) for c, e in empty.items()),
        F.col("_r")["sentiment_score"].alias("sentiment_score"), as_map(measured).alias("complexity_metrics"),
    )


#: What models want before a passage that is to be found again, by a part of their name. Fixed values.
PREFIXES = {"e5": "passage: "}


def passage_prefix(model_name: str) -> str:
    return next((p for part, p in PREFIXES.items() if part in re.split(r"[-/_.]", model_name.lower())), "")


#: Words whose digests an embedder keeps.
MOST_WORDS = 1 << 17


class HashingEmbedder:
    """Signed word digests summed and scaled to unit length: deterministic, no model."""

    model_name = "hashing"

    def __init__(self, dim: int = 256):
        self.dim = dim
        self._known: dict[str, int] = {}

    @property
    def embedding_dim(self) -> int:
        return self.dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        import math

        import numpy as np

        out, known = [], self._known
        for text in texts:
            if len(known) > MOST_WORDS:
                known.clear()
            v = np.zeros(self.dim)
            for w in (text or "").lower().split():
                h = known.get(w)
                if h is None:
                    h = known[w] = int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big")
                v[h % self.dim] += 1.0 if h & 0x80000000 else -1.0
            norm = math.sqrt(float(v @ v))
            out.append((v / norm if norm else v).astype(np.float32).tolist())
        return out

    def embed_single(self, text: str) -> list[float]:
        return self.embed([text])[0]


@dataclass(frozen=True)
class Factory:
    """What makes a backend in a worker, with a key that tells it from others."""

    key: str
    make: Callable


#: Models that a worker keeps; the oldest goes.
MOST_LOADED = 4
_loaded: dict = {}


def shared(backend):
    """A backend as it is, or a class or other callable that makes one as a ``Factory``. Its key is a digest of its
    pickled form, so two functions of one name, or of one body over other values, make a model each."""
    if isinstance(backend, Factory) or not callable(backend):
        return backend
    if not isinstance(backend, type) and any(hasattr(backend, m) for m in ("embed", "reply", "extract_batch")):
        return backend
    return Factory(hashlib.sha256(cloudpickle.dumps(backend)).hexdigest(), backend)


def loaded(backend):
    """A backend as it is, or what its factory makes: once in a worker, so that a model is neither sent with each
    task nor loaded by each."""
    backend = shared(backend)
    if not isinstance(backend, Factory):
        return backend
    if backend.key not in _loaded:
        while len(_loaded) >= MOST_LOADED:
            del _loaded[next(iter(_loaded))]
        _loaded[backend.key] = backend.make()
    return _loaded[backend.key]


def embed(documents: DataFrame, embedder=None, prefix: str | None = None, cap: int | None = None, model_name: str | None = None) -> DataFrame:
    """Embedding records of ``documents`` (doc_id, text, party, country_code, language, date). embedder: an
    object, or what makes one in a worker; a function has to be given the ``model_name``. prefix: what stands before
    each text; None: what the model wants."""
    embedder = embedder or HashingEmbedder
    model_name = model_name or getattr(embedder, "model_name", None)
    if model_name is None:
        raise ValueError("model_name is needed where the embedder doesn't state it")
    embedder = shared(embedder)
    prefix = passage_prefix(model_name) if prefix is None else prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(embedder)
        for batch in slices(batches):
            vectors = model.embed(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(vectors, pa.list_(pa.float32()))], [*names, "vector"]
            )

    names = ["doc_id", "party", "country_code", "language", "year"]
    rows = documents.select(
        F.col("doc_id").cast("string").alias("doc_id"), "party", "country_code", "language", F.year("date").alias("year"),
        F.concat(F.lit(prefix), _text(cap)).alias("text"),
    )
    made = rows.mapInArrow(run, "doc_id string, party string, country_code string, language string, year int, vector array<float>")
    return made.withColumn("model_name", F.lit(model_name)).select(*schemas.EMBEDDINGS.names)
