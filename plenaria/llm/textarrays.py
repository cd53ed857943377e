"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of a batch."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_up: np.ndarray = np.empty(0, np.uint64)
_down: np.ndarray = np.empty(0, np.uint64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], from prefix sums of a polynomial modulo 2**64."""
    global _up, _down
    n = len(data) + 1
    if len(_up) < n:
        size = max(n, CHUNK_BYTES + 1024)
        _up, _down = _powers(_BASE, size), _powers(_INVERSE, size)
    sums = np.empty(n, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _up[: n - 1], out=sums[1:])
    if n > CHUNK_BYTES + 1024:
        h = (sums[end] - sums[start]) * _down[start]
        _up, _down = np.empty(0, np.uint64), np.empty(0, np.uint64)
        return mixed(h)
    return mixed((sums[end] - sums[start]) * _down[start])


def trimmed(work: Callable) -> Callable:
    """``work``, a function of batches, that gives freed memory back to the system when it ends: workers
    live on between stages, and what their allocators keep counts against the executor."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc: nothing to trim
        pass


class Chunk:
    """Some texts, null ones empty, laid out one after another with a line feed behind each."""

    def __init__(self, rows: list[int], texts: list[bytes]):
        self.rows = rows
        self.texts = texts
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text's number) of the maximal runs of bytes that aren't ASCII white space."""
        space = np.empty(len(self.data) + 1, bool)
        space[0] = True
        np.take(_SPACE, self.data, out=space[1:])
        edges = np.flatnonzero(space[1:] != space[:-1])
        start, end = edges[::2], edges[1::2]
        return start, end, np.searchsorted(self.ends, start, side="right")


def chunks(batch: pa.RecordBatch, column: str = "text", lower: bool = False) -> Iterator[Chunk]:
    """The texts of ``batch`` in order, a bounded number of bytes at a time. lower: A-Z lower-cased."""
    rows: list[int] = []
    texts: list[bytes] = []
    size = 0
    for i, value in enumerate(batch.column(column).cast(pa.large_binary())):
        text = value.as_py() or b""
        if rows and size + len(text) > CHUNK_BYTES:
            yield Chunk(rows, texts)
            rows, texts, size = [], [], 0
        rows.append(i)
        texts.append(text.lower() if lower else text)
        size += len(text) + 1
    if rows:
        yield Chunk(rows, texts)


def per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by text's number."""
    return np.bincount(text, weights=values, minlength=n)
