"""Benchmark decontamination by spaced-seed hashing.

A fixed mask reads some of the words that follow a position and ignores the others, so that a
substituted word at an ignored place does not change the hash. Test items are hashed under every
mask at every position, documents likewise, and equal hashes are hits. Each hit fixes how document
and item would lie on each other; that alignment is verified word by word, and counts as a leak if
it holds a stretch of at least ``MIN_WORDS`` words, or of the whole item if it has fewer, of which
``SIMILARITY`` are equal. So an item of one to four words has to be there word for word, one of five to
nine with one substitution at most, one of ten to twelve with two. The masks find all of these, and
every stretch of 13 words with up to two substitutions, of 15 with three and of 20 with four.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .textarrays import Chunk, chunks, mixed, span_hashes, trimmed

#: Fixed by choice: the word positions that each mask reads.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 2, 3, 4), (0, 1, 3, 5, 6))
MIN_WORDS = 13
SIMILARITY = 0.8
#: Items of fewer words than the first are read whole; those of fewer than MIN_WORDS by these masks as well.
WHOLE_BELOW = 5
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
#: Text of test items that is hashed and sent to the executors at once; larger sets go in blocks. A word of
#: it takes 56 bytes of the index (more in items under MIN_WORDS): some 80 MB a block.
BLOCK_BYTES = 8 << 20
_BITS = 22
_FACTORS = mixed(np.arange(1, 8, dtype=np.uint64)) | np.uint64(1)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text's number) of the chunk's (lower-cased) words without the punctuation around them."""
    start, end, text = chunk.words()
    start, end = start.copy(), end.copy()
    while True:
        some = np.flatnonzero((start < end) & _PUNCTUATION[chunk.data[np.minimum(start, len(chunk.data) - 1)]])
        if not len(some):
            break
        start[some] += 1
    while True:
        some = np.flatnonzero((start < end) & _PUNCTUATION[chunk.data[np.maximum(end - 1, 0)]])
        if not len(some):
            break
        end[some] -= 1
    full = start < end
    start, end, text = start[full], end[full], text[full]
    return span_hashes(chunk.data, start, end), text


def _seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = max(0, len(hashes) - mask[-1])
    key = np.full(n, sum(1 << p for p in mask), np.uint64)
    for p, factor in zip(mask, _FACTORS, strict=False):
        key += hashes[p : p + n] * factor
    return mixed(key)


@dataclass
class Index:
    """Word hashes of some test items and, by mask, their seeds in order. Items without an id have a ``key``, by
    their text, in its place."""

    ids: pa.Array
    key: pa.Array
    words: np.ndarray
    start: np.ndarray
    length: np.ndarray
    masks: list[tuple[int, ...]]
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray
    bits: np.ndarray


def _read_by(mask: tuple[int, ...], length: np.ndarray) -> np.ndarray:
    """Which items, by their length, a mask is for."""
    if mask in MASKS:
        return length >= WHOLE_BELOW
    short = (length >= WHOLE_BELOW) & (length < MIN_WORDS) if mask in SHORT_MASKS else np.zeros(len(length), bool)
    return short | (length == len(mask)) if mask == tuple(range(len(mask))) else short


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def index(items: pa.Table) -> Index:
    words, ids, keys, lengths = [], [], [], []
    for batch in items.to_batches():
        for chunk in chunks(batch, lower=True):
            hashes, text = _words(chunk)
            counts = np.bincount(text, minlength=len(chunk.texts))
            words.append(hashes)
            lengths.append(counts)
            own = batch.take(pa.array(np.asarray(chunk.rows, np.int64)))
            ids.append(own.column("item_id").cast(pa.int64()))
            keys.append(pa.array([None if i.is_valid else _key(t.as_py()) for i, t in zip(own.column("item_id"), own.column("text"))], pa.int64()))
    word = np.concatenate(words) if words else np.empty(0, np.uint64)
    length = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(length), dtype=np.int32), length)
    masks, seeds, item, at = [], [], [], []
    for mask in (*MASKS, *SHORT_MASKS, *(tuple(range(n)) for n in range(1, WHOLE_BELOW - 1))):
        s = _seeds(word, mask)
        own = owner[: len(s)]
        inside = np.flatnonzero((own == owner[mask[-1] : mask[-1] + len(s)]) & _read_by(mask, length)[own])
        if len(inside):
            masks.append(mask)
            seeds.append(s[inside])
            item.append(own[inside])
            at.append((inside - start[own[inside]]).astype(np.int32))
    seed = np.concatenate([np.empty(0, np.uint64), *seeds])
    seed_item, seed_at = (np.concatenate([np.empty(0, np.int32), *x]) for x in (item, at))
    order = np.argsort(seed, kind="stable")
    bits = np.zeros(1 << _BITS, bool)
    bits[seed >> np.uint64(64 - _BITS)] = True
    none = pa.array([], pa.int64())
    return Index(pa.concat_arrays([none, *ids]), pa.concat_arrays([none, *keys]), word, start, length, masks, seed[order], seed_item[order], seed_at[order], bits)


def _verified(ix: Index, words: np.ndarray, first: np.ndarray, count: np.ndarray, item: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether it is a leak, equal words) of alignments: document words ``first`` to ``first + count``
    against ``item``, whose word j lies on the document's word j + ``shift``."""
    low = np.maximum(0, -shift)
    size = np.maximum(np.minimum(ix.length[item], count - shift) - low, 0)
    ends = np.cumsum(size)
    seg = np.repeat(np.arange(len(item)), size)
    at = np.arange(len(seg)) - np.repeat(ends - size, size)
    equal = words[np.repeat(first + low + shift, size) + at] == ix.words[np.repeat(ix.start[item] + low, size) + at]
    # scores of 1 - SIMILARITY and -SIMILARITY in whole units; a stretch is a leak at a sum of 0 or more
    score = np.cumsum(np.where(equal, 100 - round(100 * SIMILARITY), -round(100 * SIMILARITY)))
    before = np.concatenate([[0], score])[:-1]
    least = np.minimum(MIN_WORDS, ix.length[item])
    # prefix sums and their least so far, segment by segment: each segment is lifted below the last
    step = np.int64(1) << 40
    lowest = np.minimum.accumulate(before - seg * step) + seg * step
    back = at - (np.repeat(least, size) - 1)
    ok = np.flatnonzero(back >= 0)
    good = ok[score[ok] - lowest[ok - at[ok] + back[ok]] >= 0]
    leak = np.zeros(len(item), bool)
    leak[seg[good]] = True
    matched = np.bincount(seg, weights=equal, minlength=len(item)).astype(np.int64)
    return leak, matched


#: Hits that are put together, and words of alignments that are verified, at once.
_AT_ONCE = 2_000_000


def _hits(ix: Index, words: np.ndarray, text: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """(text's number, item's number, shift) of the hits of a chunk, so many at once; a phrase of many items
    that stands at many places gives many."""
    for mask in ix.masks:
        seeds = _seeds(words, mask)
        maybe = np.flatnonzero(ix.bits[seeds >> np.uint64(64 - _BITS)])
        maybe = maybe[text[maybe] == text[maybe + mask[-1]]]
        left = np.searchsorted(ix.seeds, seeds[maybe], side="left")
        hits = np.searchsorted(ix.seeds, seeds[maybe], side="right") - left
        ends = np.cumsum(hits)
        for lo in range(0, int(hits.sum()), _AT_ONCE):
            number = np.arange(lo, min(lo + _AT_ONCE, int(ends[-1])))
            k = np.searchsorted(ends, number, side="right")
            each = left[k] + number - (ends[k] - hits[k])
            at = maybe[k]
            yield np.stack([text[at], ix.seed_item[each], at - first[text[at]] - ix.seed_at[each]])


def _search(ix: Index, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, item's number, equal words) of the leaks in a chunk."""
    words, text = _words(chunk)
    count = np.bincount(text, minlength=len(chunk.texts))
    first = np.cumsum(count) - count
    none = np.empty(0, np.int64)
    out = [(none, none, none)]
    held: list[np.ndarray] = []

    def settle() -> None:
        if held:
            doc, item, shift = np.unique(np.concatenate(held, axis=1), axis=1)
            held.clear()
            cuts = np.flatnonzero(np.diff(np.cumsum(ix.length[item]) // _AT_ONCE)) + 1
            for part in np.split(np.arange(len(doc)), cuts):
                d, i, s = doc[part], item[part], shift[part]
                leak, equal = _verified(ix, words, first[d], count[d], i, s)
                out.append((d[leak], i[leak], equal[leak]))

    for found in _hits(ix, words, text, first):
        held.append(found)
        if sum(x.shape[1] for x in held) >= _AT_ONCE:
            settle()
    settle()
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Index]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for i in range(n):
        block = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield index(block.toArrow())


def leaks(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, key: Column | None = None) -> DataFrame:
    """(``doc_id``, ``item_id``, ``matched_words``, ``item_words``) of each document and test item that
    share a leak, once each.

    Words are lower-cased (A-Z) runs between ASCII white space, without ASCII punctuation around
    them. The benchmark goes to the executors in blocks of a bounded size, each searched for in all
    whole documents. Null or empty texts leak nothing, rows of one id count as one document, a null
    doc_id is one as well. Of items without an id, those of one text count as one, with a null ``item_id``. Items
    without a word are in no document, and an empty table gives no rows. Other columns are not used. ``key``: what identifies a document, in place of its doc_id and in
    a column of that name.
    """
    spark = documents.sparkSession
    rows = documents.select((F.col("doc_id").cast("long") if key is None else key).alias("doc_id"), "text")
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("item_id", "key", "matched_words", "item_words"))])
    found, names = spark.createDataFrame([], schema), schema.names[1:]
    for ix in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk in chunks(batch, lower=True):
                    ix = shared.value
                    doc, item, equal = _search(ix, chunk)
                    if len(doc):
                        ids = batch.column("doc_id").take(pa.array(np.asarray(chunk.rows)[doc]))
                        of = pa.array(item)
                        counts = (pa.array(np.asarray(x, np.int64)) for x in (equal, ix.length[item]))
                        yield pa.RecordBatch.from_arrays([ids, ix.ids.take(of), ix.key.take(of), *counts], ["doc_id", *names])

        found = found.unionByName(rows.mapInArrow(trimmed(run), schema))
    most = (F.max("matched_words").alias("matched_words"), F.max("item_words").alias("item_words"))
    return found.groupBy("doc_id", "item_id", "key").agg(*most).drop("key")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark."""
    return leaks(table(spark, sf_dir, "documents", even=True), table(spark, sf_dir, "benchmark"))
