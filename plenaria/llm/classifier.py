"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words (runs of letters, of digits and of other characters) are hashed to a fixed number of slots.
Each slot has a sparse index vector of +1 and -1 drawn from its number, and a context vector: the
sum of the index vectors of its neighbours, over every occurrence in all documents. Both, scaled to
unit length, make the word's vector, held in whole units so that sums do not depend on their order; a
document's is the mean over its words. Words are told apart by case. A network with one hidden layer learns the labels
from a bounded sample, and its logits are divided by a temperature fitted to part of the sample that
it has not seen, so that scores are probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .textarrays import Chunk, chunks, mixed, per_text, span_hashes, trimmed

SLOTS = 1 << 15
DIMENSIONS = 32
NONZERO = 4
REACH = 2
#: Most labelled rows that the network is fitted to: those whose id hashes lowest.
SAMPLE_ROWS = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-4
THRESHOLD = 0.3
HELD_OUT_MODULUS = 5
#: Vectors are rounded to this part of one.
UNIT = 1 << 20

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[[*range(48, 58)]] = 2


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs) of the nonzero parts of every slot's index vector."""
    n = np.arange(SLOTS * NONZERO, dtype=np.uint64).reshape(SLOTS, NONZERO)
    h = mixed(n + np.uint64(0x51ED2701))
    width = DIMENSIONS // NONZERO  # each nonzero part has a stretch of its own, so none cancel
    place = (h % np.uint64(width)).astype(np.int64) + np.arange(NONZERO) * width
    return place, np.where((h >> np.uint64(40)) & np.uint64(1), 1, -1)


_PLACE, _SIGN = index_vectors()


def _tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text's number) of the words of the chunk, in order."""
    kind = np.concatenate([[0], _CLASS[chunk.data], [0]])
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    if len(edge) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = kind[edge[:-1] + 1] != 0
    start, end = edge[:-1][word], edge[1:][word]
    h = span_hashes(chunk.data, start, end)
    return (h >> np.uint64(64 - 15)).astype(np.int64), np.searchsorted(chunk.ends, start, side="right")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS * DIMENSIONS)
    for batch in batches:
        for chunk in chunks(batch):
            slot, text = _tokens(chunk)
            for reach in range(1, REACH + 1):
                near = np.flatnonzero(text[reach:] == text[:-reach])
                a, b = slot[near], slot[near + reach]
                for x, y in ((a, b), (b, a)):
                    for i in range(NONZERO):
                        total += np.bincount(x * DIMENSIONS + _PLACE[y, i], weights=_SIGN[y, i], minlength=len(total))
    rows = total.reshape(SLOTS, DIMENSIONS).astype(np.int64)
    some = np.flatnonzero(rows.any(axis=1))
    for at in range(0, len(some), 4096):
        part = some[at : at + 4096]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), *(pa.array(rows[part, d].copy()) for d in range(DIMENSIONS))],
            ["slot", *(f"c{d}" for d in range(DIMENSIONS))],
        )


def word_vectors(documents: DataFrame) -> np.ndarray:
    """A vector for each slot, in units of 1 / UNIT, from the contexts in all documents: SLOTS rows, whatever
    the corpus."""
    names = [f"c{d}" for d in range(DIMENSIONS)]
    schema = ", ".join(["slot long", *(f"{c} long" for c in names)])
    sums = (
        documents.select("text").mapInArrow(trimmed(_contexts), schema).groupBy("slot").agg(*(F.sum(c).alias(c) for c in names))
    ).toArrow()
    vectors = np.zeros((SLOTS, 2 * DIMENSIONS))
    for i in range(NONZERO):
        vectors[np.arange(SLOTS), _PLACE[:, i]] = _SIGN[:, i] / np.sqrt(NONZERO)
    if sums.num_rows:
        context = np.stack([sums.column(c).to_numpy() for c in names], axis=1).astype(np.float64)
        length = np.linalg.norm(context, axis=1, keepdims=True)
        vectors[sums.column("slot").to_numpy(), DIMENSIONS:] = context / np.maximum(length, 1)
    return np.rint(vectors * UNIT).astype(np.int32)


def pooled(chunk: Chunk, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: the mean word vector, the length of its two halves, the mean product of the index
    vectors of words so far apart as neighbours reach, and the text's length. Sums are of whole numbers,
    so a text has the same features whatever texts share its chunk."""
    slot, text = _tokens(chunk)
    n = len(chunk.texts)
    sums = np.zeros((n, vectors.shape[1]), np.int64)
    for at in range(0, len(slot), 1 << 15):
        own = text[at : at + (1 << 15)]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sums[own[first]] += np.add.reduceat(vectors[slot[at : at + (1 << 15)]], first, axis=0, dtype=np.int64)
    count = np.bincount(text, minlength=n)[:, None]
    mean = sums / (UNIT * np.maximum(count, 1))
    norms = [np.linalg.norm(part, axis=1, keepdims=True) for part in (mean[:, :DIMENSIONS], mean[:, DIMENSIONS:])]
    near = []
    for reach in range(1, REACH + 1):
        a, b = slot[:-reach], slot[reach:]
        alike = sum(np.where(_PLACE[a, i] == _PLACE[b, i], _SIGN[a, i] * _SIGN[b, i], 0) for i in range(NONZERO))
        alike[text[:-reach] != text[reach:]] = 0
        near.append(per_text(alike, text[: len(alike)], n)[:, None] / (NONZERO * np.maximum(count - reach, 1)))
    return np.concatenate([mean, *norms, *near, np.log1p(count) / 10], axis=1)


#: Numbers that ``pooled`` gives of a text.
FEATURES = 2 * DIMENSIONS + 3 + REACH


@dataclass
class Network:
    """A hidden layer, an output and a temperature over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Fit to four fifths of the rows by Adam, and the temperature to the rest. Without rows of both
    labels, the score is the share of label 1 (one half if there are no rows)."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    test, train = order[:cut], order[cut:]
    net = Network(
        x[train].mean(axis=0),
        np.maximum(x[train].std(axis=0), 1e-6),
        rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN),
        0.0,
    )
    z = np.clip((x - net.mean) / net.scale, -8, 8)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), 256):
            rows = train[at : at + 256]
            hidden = np.maximum(z[rows] @ params[0] + params[1], 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -30, 30)))
            g = (p - y[rows]) / len(rows)
            back = np.outer(g, params[2]) * (hidden > 0)
            grads = [z[rows].T @ back + DECAY * params[0], back.sum(axis=0), hidden.T @ g + DECAY * params[2], np.array([g.sum()])]
            step += 1
            for param, (m, v), grad in zip(params, moments, grads, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits = net.logit(x[test])
    grid = np.geomspace(0.25, 8, 121)
    loss = [np.mean(np.logaddexp(0, np.where(y[test] == 1, -1, 1) * logits / t)) for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MODULUS == 0


def sample(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(``doc_id``, ``label``) of at most ``rows`` labelled ids that aren't held out. An id with several
    labels counts as the lowest; null ids and labels are left out."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .filter("doc_id IS NOT NULL AND label IS NOT NULL")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )


@dataclass
class Model:
    vectors: np.ndarray
    network: Network


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Word vectors of all ``documents``, and the network of a bounded sample of the ``labels``."""
    vectors = word_vectors(documents)
    shared = documents.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                part = batch.slice(chunk.rows[0], len(chunk.rows))
                x = pooled(chunk, shared.value)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), flat], ["doc_id", "label", "x"])

    chosen = F.broadcast(sample(labels, rows))  # at most ``rows`` rows
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    found = texts.mapInArrow(trimmed(features), "doc_id long, label int, x array<double>")
    # an id that rows repeat counts once, by the least of their features: at most ``rows`` rows
    found = found.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("x").alias("x")).toArrow()
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(found.num_rows, FEATURES)
    y = found.column("label").to_numpy().astype(np.float64)
    order = np.argsort(found.column("doc_id").to_numpy())
    return Model(vectors, fit(x[order], y[order]))


def score(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``documents`` and, as ``name`` (one they don't have), the probability of label 1.
    A null or empty text is scored as a text without words; an empty table gives no rows."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                part = batch.slice(chunk.rows[0], len(chunk.rows))
                p = shared.value.network.probability(pooled(chunk, shared.value.vectors))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.round(p, 9))], [*part.schema.names, name])

    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())])
    return documents.mapInArrow(trimmed(run), schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    documents = table(spark, sf_dir, "documents", even=True).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
