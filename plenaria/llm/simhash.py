"""SimHash near-duplicates by an inverted index on byte positions with count filtering.

Fingerprints of 64 bits are eight bytes at eight positions. Two that differ in at most three bits
share at least five positional bytes, so five is the guaranteed minimum of the count filter.
Tallying shared single bytes would go through lists of a 256th of the corpus, so the index holds
combinations of four positional bytes: a family of 4-subsets of the eight positions such that
each 5-subset contains one of them (a pair with five shared bytes shares a whole key). Under a
key the remaining bytes are tallied, pairs below the minimum are dropped, and the rest verified by
their differing bits.

Equal fingerprints are one entry of the index. Keys are counted first. The entries of a key with more
than ``BLOCK`` of them are keyed again by one more positional byte, which the count filter demands
anyway, before anything is shuffled; what shares five bytes differs in three only, so such a key has
2**24 entries at most, and if it is large still, the neighbours of each entry are looked up in its
sorted list. Only a spanning forest of a key's links is kept, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, small_join, spread_join, table
from .components import components
from .textarrays import Chunk, chunks, trimmed

SHINGLE = 3
SEED = 42
MAX_BITS = 3
MIN_BYTES = 8 - MAX_BITS
KEY_BYTES = 4
#: Entries of a key that are compared with each other at once.
BLOCK = 2048


def _covering() -> tuple[tuple[int, ...], ...]:
    """4-subsets of the eight positions, one within every 5-subset, chosen greedily in natural order."""
    left = set(combinations(range(8), MIN_BYTES))
    family = []
    while left:
        best = max(combinations(range(8), KEY_BYTES), key=lambda k: sum(set(k) <= set(s) for s in left))
        family.append(best)
        left = {s for s in left if not set(best) <= set(s)}
    return tuple(family)


KEYS = _covering()
FIVES = tuple(combinations(range(8), MIN_BYTES))
#: Marks keys of five positional bytes: their combination's number and the bytes follow.
_LONGER = 1 << 62


def _fingerprint(chunk: Chunk) -> np.ndarray:
    """Fingerprints of the chunk's (lower-cased) texts: eight bytes each, most significant first."""
    out = np.zeros((len(chunk.texts), 8), np.uint8)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(chunk.texts):
        words = text.split()
        if not words:
            continue
        if len(words) > SHINGLE:
            hashes = [digest(a + b" " + b + b" " + c, SEED) for a, b, c in zip(words, words[1:], words[2:])]
        else:
            hashes = [digest(b" ".join(words), SEED)]
        counts = np.zeros(64, np.int64)
        rows = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
        for at in range(0, len(rows), 1 << 14):
            counts += np.unpackbits(rows[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > len(hashes))
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch, lower=True):
            part = batch.slice(chunk.rows[0], len(chunk.rows))
            prints = _fingerprint(chunk).view(">i8").ravel().astype(np.int64)
            kept = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(prints)], [*kept, "print"])


def fingerprints(documents: DataFrame, **columns: Column) -> DataFrame:
    """``doc_id``, the ``columns`` asked for and ``print`` (the fingerprint's bits as a signed number) of
    every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c.alias(n) for n, c in columns.items()))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "text"), T.StructField("print", T.LongType())])
    return rows.mapInArrow(trimmed(_fingerprints), schema)


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _forest(a: np.ndarray, b: np.ndarray, n: int, parent: np.ndarray, out: list[tuple[int, int]]) -> None:
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = _find(parent, x), _find(parent, y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))


def _close(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) <= MAX_BITS


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tally of positional bytes that each pair shares."""
    x = np.ascontiguousarray(a ^ b)
    return np.count_nonzero(x.view(np.uint8).reshape(*x.shape, 8) == 0, axis=-1)


def _neighbours(prints: np.ndarray, parent: np.ndarray, out: list, free: list[int]) -> None:
    """Links within sorted ``prints`` that differ in bits of ``free`` only, by looking up each flip."""
    for size in range(1, MAX_BITS + 1):
        for bits in combinations(free, size):
            flip = np.uint64(sum(1 << b for b in bits))
            want = prints ^ flip
            larger = np.flatnonzero(want > prints)
            at = np.minimum(np.searchsorted(prints, want[larger]), len(prints) - 1)
            hit = prints[at] == want[larger]
            hit[hit] = _shared(prints[larger[hit]], prints[at[hit]]) >= MIN_BYTES
            _forest(larger[hit], at[hit], len(prints), parent, out)


def _links(prints: np.ndarray, key: tuple[int, ...]) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``prints`` (distinct, sorted), which share the bytes at the
    positions ``key``, as index pairs."""
    n = len(prints)
    parent, out = np.arange(n), []
    if n > BLOCK and len(key) >= MIN_BYTES:
        _neighbours(prints, parent, out, [b for p in range(8) if p not in key for b in range(8 * (7 - p), 8 * (8 - p))])
        return out
    for at in range(0, n, 256):
        block = prints[at : at + 256]
        a, b = np.nonzero(_shared(block[:, None], prints[None, :]) >= MIN_BYTES)
        keep = a + at < b
        a, b = a[keep] + at, b[keep]
        verified = _close(prints[a] ^ prints[b])
        _forest(a[verified], b[verified], n, parent, out)
    return out


def _bytes_at(prints: np.ndarray, positions: tuple[int, ...]) -> np.ndarray:
    found = np.zeros(len(prints), np.uint64)
    for p in positions:
        found = (found << np.uint64(8)) | ((prints >> np.uint64(8 * (7 - p))) & np.uint64(255))
    return found


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries: for each fingerprint, its key under each combination of positions."""
    for batch in batches:
        column = batch.column("print")
        prints = column.to_numpy().astype(np.int64).view(np.uint64)
        for i, positions in enumerate(KEYS):
            key = np.uint64(i << 32) | _bytes_at(prints, positions)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), column], ["key", "print"])


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of large keys under each combination of five positions that their key's four lie within."""
    for batch in batches:
        prints = batch.column("print").to_numpy().astype(np.int64).view(np.uint64)
        own = batch.column("key").to_numpy() >> 32
        for i in np.unique(own).tolist():
            some = prints[own == i]
            for k, five in enumerate(FIVES):
                if set(KEYS[i]) <= set(five):
                    key = np.uint64(_LONGER | k << 40) | _bytes_at(some, five)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, some)], ["key", "print"])


def _positions(key: int) -> tuple[int, ...]:
    return FIVES[(key ^ _LONGER) >> 40] if key & _LONGER else KEYS[key >> 32]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the keys in a partition sorted by key; a key's entries are put together once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held_key, held = 0, []

    def pairs(key: int, prints: np.ndarray) -> np.ndarray:
        own = np.unique(prints)
        found = _links(own, _positions(key)) if len(own) > 1 else []
        return own[np.array(found)] if found else np.empty((0, 2), np.uint64)

    def rows(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate([np.empty((0, 2), np.uint64), *found])
        return pa.RecordBatch.from_arrays([pa.array(both[:, i].copy().view(np.int64)) for i in (0, 1)], schema=schema)

    for batch in batches:
        key = batch.column("key").to_numpy()
        prints = batch.column("print").to_numpy().astype(np.int64).view(np.uint64)
        if not len(key):
            continue
        found = []
        if held and key[0] != held_key:
            found.append(pairs(held_key, np.concatenate(held)))
            held = []
        cuts = np.flatnonzero(np.diff(key)) + 1
        if len(cuts):
            starts, ends = np.concatenate([[0], cuts[:-1]]), cuts
            first = np.concatenate([*held, prints[: ends[0]]])
            found.append(pairs(int(key[0]), first))
            many = np.flatnonzero(ends - starts > 1)
            for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
                if s:
                    found.append(pairs(int(key[s]), prints[s:e]))
            held = []
            prints = prints[cuts[-1] :]
        held_key = int(key[-1])
        held.append(prints)
        if found:
            yield rows(found)
    if held:
        yield rows([pairs(held_key, np.concatenate(held))])


def links(prints: DataFrame) -> DataFrame:
    """(``a``, ``b``): fingerprints that differ in 1 to MAX_BITS bits, a spanning forest by key of all
    such links among the distinct ``prints``."""
    entry = "key long, print long"
    entries = prints.select("print").distinct().mapInArrow(trimmed(_candidates), entry)
    large = scratch(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("key"), "large-keys")
    if not large.isEmpty():
        marked = small_join(entries, large.withColumn("_large", F.lit(True)), "key", "left", F.lit(32))
        again = marked.filter("_large").select("key", "print").mapInArrow(trimmed(_longer), entry)
        entries = marked.filter("_large IS NULL").select("key", "print").unionByName(again)
    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(_linked), "a long, b long").distinct()


def near_duplicates(documents: DataFrame, **columns: Column) -> DataFrame:
    """``doc_id``, the ``columns`` asked for, ``fingerprint``, ``component_id`` and ``component`` (the least
    fingerprint of the component, as a signed number) of every row of ``documents``.

    A null text, or one without a word, has fingerprint zero and is linked like any other. Repeated
    rows share their fingerprint and so their component. A null id has a fingerprint and a component, and a
    component id only if its component holds an id that isn't null. An empty table gives no rows;
    other columns are not used.
    """
    prints = scratch(fingerprints(documents, **columns), "prints")
    entries = prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    found = scratch(links(prints), "links")
    alone = F.col("least")
    if found.isEmpty():
        entries = entries.withColumns({"component_id": alone, "component": F.col("print")})
    else:
        nodes = components(found, "a", "b")
        joined = entries.join(nodes.withColumnRenamed("node", "print"), "print", "left")
        smallest = joined.groupBy("component").agg(F.min("least").alias("_smallest"))
        entries = joined.join(smallest.filter("component IS NOT NULL"), "component", "left").select(
            "print",
            "n",
            F.when(F.col("component").isNull(), alone).otherwise(F.col("_smallest")).alias("component_id"),
            F.coalesce("component", "print").alias("component"),
        )
    entries = scratch(entries.select("print", "n", "component_id", "component"), "entries")
    total = entries.agg(F.sum("n")).first()[0] or 0  # equal texts, empty ones above all, may be a third of the rows
    return spread_join(prints, entries, "print", total).select(
        "doc_id", *columns, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "component"
    )


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents", even=True)).select("doc_id", "fingerprint", "component_id")
