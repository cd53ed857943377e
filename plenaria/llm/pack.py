"""Best-fit packing with exact-complement hashing.

Documents become token pieces of at most ``capacity``; only their lengths matter for packing, so the
plan is made from the count of pieces of each length: at most ``capacity`` numbers, whatever the
corpus. The plan is a list of patterns (lengths that share a sequence) with multiplicities. Each
step takes the longest length left, then consumes a single length, pair or triple that fills the
gap exactly, found by hashing sums to available lengths; only where none exists does best fit take
the longest length that still fits. A step repeats its pattern until one of its lengths runs out,
so there are about as many patterns as lengths. Pieces then find their place by their rank among
pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table
from .textarrays import trimmed

CAPACITY = 2048
SEPARATOR = (0).to_bytes(4, "little")
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a task keeps; the cache starts anew beyond that. No effect on results.
CACHED_WORDS = 400_000


#: Words that the short way below treats: printable ASCII and precomposed Latin letters.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_PLAIN = re.compile(f"[!-~{_LATIN}]+")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")


def _byte_letters() -> dict[int, int]:
    """Letter by byte in byte-level vocabularies: visible Latin-1 is itself, the rest follows from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(rest)}


class _Ids(dict):
    """Little-endian ids by word. The tokenizer cuts at all white space and merges nothing across
    it, so a text's ids are those of its words, which repeat far more often than texts do. Most new
    words go the short way: lower case, cut into parts as the tokenizer does, its model on each."""

    def __init__(self, path: str):
        super().__init__()
        tokenizer = _tokenizer(path)
        self._encode = tokenizer.encode
        self._model = tokenizer.model
        self._special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        self._letters = _byte_letters()
        self._parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(self._letters)
        ids = array("I", [t.id for t in self._model.tokenize(letters)]).tobytes()
        self._parts[part] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        text = word.decode()
        if _PLAIN.fullmatch(text) and not any(s in text for s in self._special):
            if len(self._parts) >= CACHED_WORDS:
                self._parts.clear()
            known = self._parts.get
            ids = b"".join([known(p) or self._part(p) for p in _PARTS.findall(text.lower())])
        else:
            ids = array("I", self._encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)



PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def _cutter(path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(path)
        step = 4 * capacity
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = b"".join([ids[w] for w in (text.as_py() or "").encode().split()]) + SEPARATOR
                for piece, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, PIECES.types, strict=True)], schema=PIECES)

    return trimmed(cut)


def pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of every piece of every row."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_cutter(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _exact_fill(count: np.ndarray, gap: int) -> tuple[int, ...]:
    """Lengths, longest first, that add up to ``gap`` exactly: one, two or three of those available."""
    if count[gap]:
        return (gap,)
    top = np.arange(gap - 1, (gap - 1) // 2, -1)
    need = 1 + (2 * top == gap)
    pair = top[(count[top] >= need) & (count[gap - top] >= 1)]
    if len(pair):
        return int(pair[0]), int(gap - pair[0])
    have = np.flatnonzero(count[:gap])
    for a in have[::-1]:
        rest = gap - int(a)
        if 3 * int(a) < gap:
            break
        b = have[(have <= a) & (2 * have >= rest) & (have < rest)]
        c = rest - b
        enough = (count[c] >= 1) & (count[b] >= 1 + (b == c)) & (count[a] >= 1 + (b == a) + (c == a))
        if enough.any():
            b = int(b[enough][-1])
            return int(a), b, rest - b
    return ()


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(multiplicity, lengths) patterns that hold exactly the pieces counted by length."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        count[length] = n
    patterns = []
    longest = capacity
    while True:
        while longest and not count[longest]:
            longest -= 1
        if not longest:
            return patterns
        pattern = [longest]
        count[longest] -= 1
        gap = capacity - longest
        while gap:
            fill = _exact_fill(count, gap)
            if not fill:
                fits = np.flatnonzero(count[: gap + 1])
                if not len(fits):
                    break
                fill = (int(fits[-1]),)
            for x in fill:
                count[x] -= 1
                gap -= x
            pattern += fill
        lengths, uses = np.unique(pattern, return_counts=True)
        more = int((count[lengths] // uses).min())
        count[lengths] -= more * uses
        patterns.append((1 + more, tuple(pattern)))


def _places(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): where the pieces of a length go by rank."""
    rows, used, sequence = [], {}, 0
    for times, pattern in patterns:
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            rows.append((length, first, times, sequence, offset))
            used[length] = first + times
            offset += length
        sequence += times
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (rows with doc_id, piece, start, length 1..capacity) with ``sequence_id`` and ``offset``.

    Ranks within a length are counted in slices by hash, so that a length which very many pieces
    have is not ranked in one task; the slices' counts and the plan are bounded by lengths times
    slices. ``cut`` must be a written table: it is read twice. Equal rows get places of their own.
    """
    spark = cut.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(slices)).cast("int")
    sliced = cut.withColumn("_slice", key)
    sizes = sliced.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.createDataFrame(
        _places(plan(counts, capacity)), "length long, _first long, _ranks long, _sequence long, offset long"
    )
    # the plan's intervals of a length, gathered to one row for each: a bounded table, sent to all
    by_length = places.groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("_first", "_ranks", "_sequence", "offset"))).alias("_at")
    )
    w = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        sliced.withColumn("_local", F.row_number().over(w))
        .join(starts, ["length", "_slice"])
        .withColumn("_rank", F.col("_before") + F.col("_local") - 1)
    )
    found = F.filter("_at", lambda p: (p["_first"] <= F.col("_rank")) & (F.col("_rank") < p["_first"] + p["_ranks"]))[0]
    return (
        ranked.join(F.broadcast(by_length), "length")
        .withColumn("_p", found)
        .withColumn("sequence_id", F.col("_p._sequence") + F.col("_rank") - F.col("_p._first"))
        .withColumn("offset", F.col("_p.offset"))
        .select(*cut.columns, "sequence_id", "offset")
    )


def pack_documents(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every row of ``documents`` with their place: ``sequence_id`` and ``offset``.

    A text's ids end in id 0; a null or empty text is that id alone. Longer ones are cut at every
    ``capacity`` ids. Repeated rows are packed like others, null ids stay null, an empty table
    gives no rows, other columns are not used. A place in the plan is given to each piece: nothing
    is dropped, and sequences are filled from offset 0 without gaps.
    """
    return pack(scratch(pieces(documents, path, capacity), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents", even=True))
