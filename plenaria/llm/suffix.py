"""Removal of passages that repeat across documents, by suffix arrays built with induced sorting.

Every ``LENGTH``-byte window of a text has an anchor: the leftmost of the ``GRAM``-byte strings in it
whose hash is least. Equal windows have equal anchors, so windows can be dealt to shards by anchor
and no shard needs the whole corpus. Neighbouring windows of one anchor travel as one segment.

1. Documents are dealt to buckets of a bounded size, written once. Each bucket sends the hashes of
   its anchors, once each, to ranges of hashes; a range answers which of them any other document has.
2. Buckets send the segments of shared anchors, once each with the least doc_id, to shards. A shard
   builds the suffix array of its segments, but for those whose anchor, with the half of a window's other bytes that
   stand before or behind it, no different segment has, as their windows are in no other: suffixes are classified, leftmost-smaller substrings
   are sorted and named, the string of names is sorted by pairs until they cover
   a window, and the array is induced from them in linear passes over the byte buckets. Permuted common prefixes tell which
   neighbouring suffixes share a window, and each window's least doc_id goes back to the buckets.
3. Buckets mark the windows that a document with a smaller doc_id also has, and cut them out.

Anchors of very many different segments are dealt window by window instead, so that no shard grows with one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import forget_at_exit, scratch, scratch_dir, table
from .textarrays import give_back, mixed

LENGTH = 50
#: So long that different texts hardly share one by chance, however many they are; longer ones make more segments.
GRAM = 24
#: Bytes of text in a bucket, of hashes in a range, and of text that a shard answers for, about.
BUCKET_BYTES, RANGE_BYTES, SHARD_BYTES = 6 << 20, 16 << 20, 8 << 20
#: Bytes whose anchors are found at once: so few that the steps between stay in a core's cache.
SLICE = 1 << 16
#: Buckets that may have an anchor, and different segments that it may have in them, before its windows are
#: dealt one by one, of LENGTH bytes each. So many segments are less than a shard answers for, and an anchor has
#: one at least in each of its buckets: fewer buckets would bound nothing, but grow with the table.
HOT_BUCKETS = HOT_SEGMENTS = 1 << 15
#: Segments of an anchor in a bucket that count as different unseen.
FEW = 16
_NOBODY = np.iinfo(np.int64).max
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_GRAM_STEPS = (*range(0, GRAM - 8, 8), GRAM - 8)
#: Bytes that a window has before its anchor, or else behind it, at least; two words of eight cover them.
BEFORE = (LENGTH - GRAM) // 2
BEHIND = LENGTH - GRAM - BEFORE + 1
#: Of the hash that puts equal strings side by side.
_FACTOR = _K2


def _words8(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each position on as a number, zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), f"{order}u8", padded, 0, (1,)).astype(np.uint64)


# --- suffix arrays -------------------------------------------------------------------------------


def _classify(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the empty suffix is the least)."""
    n = len(s)
    differs = np.empty(n, bool)
    differs[:-1] = s[1:] != s[:-1]
    differs[-1] = True
    at = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.zeros(n, bool)
    smaller[:-1] = s[:-1] < s[1:]
    return smaller[nearest]


def _deal(suffixes: np.ndarray, s: np.ndarray, lists: list[list[np.ndarray]]) -> None:
    """Append suffixes, in order, to the lists of their first bytes."""
    if not len(suffixes):
        return
    first = s[suffixes]
    order = np.argsort(first, kind="stable")
    first, suffixes = first[order], suffixes[order]
    cuts = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)]
    for c, a, b in zip(first[cuts[:-1]].tolist(), cuts, cuts[1:]):
        lists[c].append(suffixes[a:b])


def _induce(s: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """The suffix array from the leftmost-smaller suffixes in their order, bucket by bucket.

    Within a bucket, suffixes that induce others of the same bucket are worked off in waves: as
    many as the longest run of its byte.
    """
    n = len(s)
    given: list[list[np.ndarray]] = [[] for _ in range(256)]
    _deal(leftmost, s, given)
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    large[s[n - 1]].append(np.array([n - 1], leftmost.dtype))

    induces = {False: np.concatenate([[False], ~smaller[:-1]]), True: np.concatenate([[False], smaller[:-1]])}

    def before(suffixes: np.ndarray, kind: bool) -> np.ndarray:
        return suffixes[induces[kind][suffixes]] - 1

    for c in range(256):
        done = 0
        while done < len(large[c]):
            wave = np.concatenate(large[c][done:])
            large[c][done:] = [wave]
            done += 1
            _deal(before(wave, False), s, large)
        for part in given[c]:
            _deal(before(part, False), s, large)
    small: list[list[np.ndarray]] = [[] for _ in range(256)]
    for c in range(255, -1, -1):
        done = 0
        while done < len(small[c]):
            wave = np.concatenate(small[c][done:])
            small[c][done:] = [wave]
            done += 1
            _deal(before(wave, True), s, small)
        for part in large[c][::-1]:
            _deal(before(part[::-1], True), s, small)
    return np.concatenate([x for c in range(256) for x in (*large[c], *(part[::-1] for part in small[c][::-1]))])


def _names(s: np.ndarray, ordered: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of leftmost-smaller substrings s[p:ends[p]] along ``ordered``, equal ones sharing theirs."""
    words = _words8(s)
    a, b = ordered[:-1], ordered[1:]
    size = ends[b] - b
    same = ends[a] - a == size
    k = 0
    active = np.flatnonzero(same)
    while len(active):
        x, y = a[active] + k, b[active] + k
        left = np.minimum(size[active] - k, 8)
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - left.astype(np.uint64)))
        equal = ((words[x] ^ words[y]) & keep) == 0
        same[active[~equal]] = False
        k += 8
        active = active[equal]
        active = active[size[active] > k]
    return np.concatenate([[0], np.cumsum(~same)])


def _sorted_names(names: np.ndarray, need: int) -> np.ndarray:
    """Ranks of the suffixes of ``names``: by pairs of names, then of such pairs, until no two are equal or
    a rank covers ``need`` symbols, beyond which order does not matter. Only equal ones are sorted again."""
    m, covered = len(names), 1
    order = np.argsort(names)
    ordered = names[order]
    ranks = np.empty(m + 1, np.int64)
    ranks[m] = -1  # of what lies behind the end
    at = np.arange(m)
    while True:
        # a rank is the first place of those that share it
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        ranks[order] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if covered >= need or not len(tied):
            return ranks[:m]
        order, at = order[tied], at[tied]
        pairs = ranks[order] * (m + 1) + ranks[np.minimum(order + covered, m)] + 1
        by = np.argsort(pairs)
        order, ordered = order[by], pairs[by]
        covered *= 2


def suffix_array(s: np.ndarray, need: int | None = None) -> np.ndarray:
    """Suffixes of the bytes ``s`` in order; with ``need``, by their first ``need`` bytes at least."""
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    smaller = _classify(s)
    leftmost = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    if len(leftmost) > 1:
        ends = np.full(n, n, np.int64)
        ends[leftmost[:-1]] = leftmost[1:] + 1
        first = _induce(s, smaller, leftmost)
        is_leftmost = np.zeros(n, bool)
        is_leftmost[leftmost] = True
        ordered = first[is_leftmost[first]]
        ranks = np.empty(n, np.int64)
        ranks[ordered] = _names(s, ordered, ends)
        # two or more bytes lie between leftmost-smaller suffixes
        names = _sorted_names(ranks[leftmost], len(leftmost) if need is None else -(-need // 2) + 1)
        leftmost = leftmost[np.argsort(names)]
    return _induce(s, smaller, leftmost)


def permuted_prefixes(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """By position: bytes, up to ``most``, that the suffix shares with the one before it in ``order``."""
    words = _words8(s, ">")
    n = len(s)
    common = np.zeros(n, np.int32)
    active, before = order[1:].astype(np.int64), order[:-1].astype(np.int64)
    k = 0
    while len(active) and k < most:
        inside = (active + k < n) & (before + k < n)
        active, before = active[inside], before[inside]
        x = words[active + k] ^ words[before + k]
        go = x == 0
        equal = np.full(len(x), 8, np.int32)
        x = x[~go]
        equal[~go] = sum((x < np.uint64(1 << (64 - 8 * b))).astype(np.int32) for b in range(1, 8))
        equal = np.minimum(equal, n - np.maximum(active, before) - k)
        common[active] = np.minimum(k + equal, most)
        active, before = active[go], before[go]
        k += 8
    return common


# --- anchors and segments ------------------------------------------------------------------------


def _words_at(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """By eight bytes, all of the strings data[at : at + size], which have LENGTH bytes at least and twice as many at most."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data),), "<u8", padded, 0, (1,))
    for begin in (at, at + size - LENGTH):
        for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
            yield words[begin + k]


def _equal_strings(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings data[at : at + size] in an order that has equal ones side by side, the first of them first, and
    whether each differs from the one before. The order is that of a hash, equality that of all bytes: strings
    that only share their hash may be told apart more often than they have to be, never less."""
    h = size.astype(np.uint64)
    for words in _words_at(data, at, size):
        h ^= h >> np.uint64(32)
        h += words
        h *= _FACTOR
    order = np.argsort(h, kind="stable")
    h, size = h[order], size[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (size[1:] != size[:-1])
    same = np.flatnonzero(~new)
    a, b = order[same - 1], order[same]
    differs = np.zeros(len(same), bool)
    for x, y in zip(_words_at(data, at[a], size[same]), _words_at(data, at[b], size[same]), strict=True):
        differs |= x != y
    new[same] = differs
    return order, new


def _gram_hashes(words: Iterator[np.ndarray]) -> np.ndarray:
    """A hash of GRAM bytes each, given eight by eight, from _GRAM_STEPS on."""
    h = next(words) * _K1
    for x in words:
        h ^= h >> np.uint64(32)
        h += x
        h *= _K2
    return h


def _again(keys: np.ndarray) -> np.ndarray:
    """Whether each key is found twice or more."""
    order = np.argsort(keys)
    new = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]], [True]])
    found = np.empty(len(keys), bool)
    found[order] = ~(new[1:] & new[:-1])
    return found


def _anchored_alike(data: np.ndarray, at: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether another of the different segments from ``at`` on may have a window of the segment. Equal windows have their anchor
    at the same place, so both hold either BEFORE bytes before it or BEHIND bytes behind it, as the place is. Windows of
    a segment whose anchor no other has with these bytes are neither in others nor again in itself, as each has another place of it."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data),), "<u8", padded, 0, (1,))
    # an anchor lies in all windows
    places = LENGTH - GRAM + 2 - windows
    first = np.cumsum(places) - places
    offset = np.arange(places.sum()) - np.repeat(first, places)
    grams = np.repeat(at + windows - 1, places) + offset
    hashes = _gram_hashes(words[grams + k] for k in _GRAM_STEPS)
    least = (np.minimum.reduceat((hashes & np.uint64(0xFFFFFFFF00000000)) | offset.astype(np.uint64), first) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    anchor = hashes[first + least]
    alike = np.flatnonzero(_again(anchor))
    place = least[alike] + windows[alike] - 1
    found = np.zeros(len(at), bool)
    # the first window has most bytes before its anchor, the last one fewest
    for here, steps in ((place >= BEFORE, (-BEFORE, -8)), (least[alike] < BEFORE, (GRAM, GRAM + BEHIND - 8))):
        some = alike[here]
        beside = (at[alike] + place)[here]
        h = anchor[some]
        for k in steps:
            h = mixed(h * _K1 + words[beside + k])
        found[some] |= _again(h)
    return found


def _joined(raw: bytes, at: np.ndarray, size: np.ndarray) -> bytes:
    return b"".join([raw[a:b] for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)])


class _Bucket:
    """The texts of a bucket in a fixed order, one after another."""

    def __init__(self, rows: pa.Table):
        rows = rows.append_column("_text", rows.column("text").cast(pa.large_binary()))
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.rows = rows.drop_columns(["_text"])
        self.texts = [x or b"" for x in rows.column("_text").to_pylist()]
        ids = rows.column("doc_id")
        self.known = np.asarray(ids.is_valid().to_numpy())
        self.ids = np.asarray(ids.fill_null(_NOBODY).to_numpy()).astype(np.int64)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.size = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size

    def segments(self, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, windows, document's number, anchor's key) of all runs of windows with one anchor."""
        found = []
        n = len(self.data)
        whole = np.ones(n, bool)  # windows that start here lie in one document with an id
        for a, b, known in zip(self.start.tolist(), self.end.tolist(), self.known.tolist(), strict=True):
            whole[max(a, b - LENGTH + 1) if known else a : b] = False
        for at in range(0, n, SLICE):
            part = self.data[at : min(n, at + SLICE + LENGTH - 1)]
            m = len(part) - LENGTH + 1
            if m <= 0:
                continue
            words = _words8(part)
            grams = len(part) - GRAM + 1
            hashes = _gram_hashes(words[k : k + grams] for k in _GRAM_STEPS)
            least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
            width, have = LENGTH - GRAM + 1, 1
            while 2 * have <= width:
                least = np.minimum(least[:-have], least[have:])
                have *= 2
            if have < width:
                least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
            own = whole[at : at + m]
            change = np.flatnonzero((least[1:] != least[:-1]) | (own[1:] != own[:-1])) + 1
            start = np.concatenate([[0], change])
            windows = np.diff(np.append(start, m))
            start, windows = start[own[start]], windows[own[start]]
            h = mixed(hashes[(least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)])
            key = ((h >> np.uint64(32)) % np.uint64(ranges) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            found.append((start + at, windows, np.searchsorted(self.end, start + at, side="right"), key))
        if not found:
            none = np.empty(0, np.int64)
            return none, none, none, np.empty(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def different(self, start: np.ndarray, windows: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many different segments each anchor has, which in ``order`` begin at ``first``. FEW and less are not looked at. A segment's first and last window are all of its bytes."""
        counts = np.diff(np.append(first, len(order)))
        many = np.flatnonzero(counts > FEW)
        if len(many):
            anchor = np.repeat(many, counts[many])
            here = order[np.arange(len(anchor)) + np.repeat(first[many] - (np.cumsum(counts[many]) - counts[many]), counts[many])]
            a, b = start[here], start[here] + windows[here] - 1
            content = self._window_hashes(a) + self._window_hashes(b) * _K1 + windows[here].astype(np.uint64)
            by = np.lexsort((content, anchor))
            anchor, content = anchor[by], content[by]
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])
            counts[many] = np.bincount(anchor[new], minlength=len(counts))[many]
        return counts

    def shared(self, answers: pa.Table, ranges: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Segments of shared anchors: (shard, start, bytes, least doc_id) of the different ones by shard, in
        order, and (shard, place, start, document's number) of all."""
        start, windows, doc, key = self.segments(ranges)
        keys, hot = [], []
        for r, low, flags in zip(*(answers.column(c).to_pylist() for c in ("range", "hashes", "hot")), strict=True):
            k = np.frombuffer(low, "<u4").astype(np.uint64) | (np.uint64(r) << np.uint64(32))
            keys.append(k)
            hot.append(np.unpackbits(np.frombuffer(flags, np.uint8), count=len(k)).astype(bool))
        known = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        hot = np.concatenate(hot) if hot else np.empty(0, bool)
        if not len(known) or not len(key):
            return np.empty((0, 4), np.int64), np.empty((0, 4), np.int64)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        # looked up in order, which is much faster
        order = np.argsort(key)
        at = np.empty(len(key), np.int64)
        at[order] = np.minimum(np.searchsorted(known, key[order]), len(known) - 1)
        mine = np.flatnonzero(known[at] == key)
        start, windows, doc, key, hot = start[mine], windows[mine], doc[mine], key[mine], hot[at[mine]]
        single = np.where(hot, windows, 1)
        if hot.any():  # a window each
            offset = np.arange(single.sum()) - np.repeat(np.cumsum(single) - single, single)
            start, doc, key = np.repeat(start, single) + offset, np.repeat(doc, single), np.repeat(key, single)
            windows = np.repeat(np.where(hot, 1, windows), single)
            hot = np.repeat(hot, single)
            whole = self._window_hashes(start[hot])
            key = key.copy()
            key[hot] = whole
        shard = (mixed(key) % np.uint64(shards)).astype(np.int64)
        size = windows + LENGTH - 1
        order, new = _equal_strings(self.data, start, size)
        first = np.flatnonzero(new)
        lead, least = order[first], np.minimum.reduceat(self.ids[doc[order]], first) if len(first) else first
        # by shard, and there as they come: their ids rise, which compresses well
        by = np.argsort(shard[lead] * len(shard) + lead)
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        lead, least = lead[by], least[by]
        place = np.empty(len(shard), np.int64)
        place[order] = number[np.cumsum(new) - 1]
        place -= np.searchsorted(shard[lead], shard)
        different = np.stack([shard[lead], start[lead], size[lead], least], axis=1)
        return different, np.stack([shard, place, start, doc], axis=1)

    def _window_hashes(self, start: np.ndarray) -> np.ndarray:
        words = np.ndarray((len(self.data),), "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), 0, (1,))
        h = np.zeros(len(start), np.uint64)
        for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
            h = mixed(h * _K1 + words[start + k])
        return h


#: Whole numbers and segments are sent compressed: of what tasks send each other, little else remains to be written.
_CODEC = "zstd"


def _zipped(values: np.ndarray) -> bytes:
    """Their number, and whole numbers by planes of bytes, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(4, "little") + pa.compress(planes, _CODEC, asbytes=True)


def _unzipped(data: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[4:], n * width, _CODEC, asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def _zipped_steps(values: np.ndarray) -> bytes:
    """The same of numbers that mostly rise, by their differences."""
    return _zipped(np.diff(values, prepend=values.dtype.type(0)))


def _unzipped_steps(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(_unzipped(data, kind), dtype=kind)


_KINDS = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "binary": T.BinaryType()}


def _struct(*fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields)])


RANGED = _struct("range int", "bucket int", "hashes binary", "twice binary", "segments binary")
ANSWERED = _struct("bucket int", "range int", "hashes binary", "hot binary")
SENT = _struct("shard int", "bucket int", "bytes binary", "sizes binary", "least binary")
FOUND = _struct("bucket int", "shard int", "counts binary", "lengths binary", "docs binary")
DIGEST = _struct("n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
OUTPUTS = {"kept": T.StructField("kept", T.StringType()), "spans": T.StructField("spans", SPANS)}


def _arrow(rows: list[tuple], schema: T.StructType) -> pa.Table:
    kinds = {T.IntegerType(): pa.int32(), T.BinaryType(): pa.binary()}
    fields = [pa.field(f.name, kinds[f.dataType]) for f in schema.fields]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    made = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))
    give_back()
    return made


def _anchors(ranges: int) -> Callable:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = _Bucket(rows)
        start, windows, doc, keys = bucket.segments(ranges)
        order = np.argsort(keys)
        keys, ids = keys[order], bucket.ids[doc][order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        twice = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(keys) else np.empty(0, bool)
        segments = _saturated(bucket.different(start, windows, order, first))
        keys = keys[first]
        out = []
        own = (keys >> np.uint64(32)).astype(np.int64)
        for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(own)) + 1):
            if len(part):
                low = _zipped_steps((keys[part] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                out.append((int(own[part[0]]), key[0].as_py(), low, np.packbits(twice[part]).tobytes(), segments[:, part].tobytes()))
        return _arrow(out, RANGED)

    return run


def _saturated(counts: np.ndarray) -> np.ndarray:
    """Counts in two planes of bytes, the upper one of which is mostly empty; the largest stands for all beyond it."""
    return np.minimum(counts, (1 << 16) - 1).astype("<u2").view(np.uint8).reshape(-1, 2).T


def _answers(hot_buckets: int, hot_segments: int) -> Callable:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        buckets = rows.column("bucket").to_pylist()
        hashes = [_unzipped_steps(x, "<u4") for x in rows.column("hashes").to_pylist()]
        twice = [
            np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool)
            for x, h in zip(rows.column("twice").to_pylist(), hashes, strict=True)
        ]
        planes = np.concatenate([np.frombuffer(x, np.uint8).reshape(2, -1) for x in rows.column("segments").to_pylist()], axis=1)
        every = np.sort(np.concatenate(hashes))
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        counts = np.diff(np.append(first, len(every)))
        every = every[first]
        # nearly all have one segment in a bucket; those of more are added
        segments, more = counts.copy(), np.flatnonzero((planes[0] > 1) | (planes[1] > 0))
        at = np.searchsorted(every, np.concatenate(hashes)[more])
        np.add.at(segments, at, planes[0][more] + (planes[1][more].astype(np.int64) << 8) - 1)
        hot_ones = (counts > hot_buckets) | (segments > hot_segments)
        out = []
        for b, h, two in zip(buckets, hashes, twice, strict=True):
            at = np.searchsorted(every, h)
            keep = (counts[at] > 1) | two
            if keep.any():
                hot = np.packbits(hot_ones[at[keep]]).tobytes()
                out.append((b, key[0].as_py(), h[keep].tobytes(), hot))
        return _arrow(out, ANSWERED)

    return run


def _send(ranges: int, shards: int) -> Callable:
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            return _arrow([], SENT)
        bucket = _Bucket(rows)
        sent, _ = bucket.shared(answers, ranges, shards)
        raw, out = bucket.data.tobytes(), []
        for part in np.split(sent, np.flatnonzero(np.diff(sent[:, 0])) + 1):
            if len(part):
                shard, start, size, least = part.T
                out.append((int(shard[0]), key[0].as_py(), _joined(raw, start, size), _zipped(size.astype("<u2")), _zipped_steps(least.astype("<i8"))))
        return _arrow(out, SENT)

    return run


def _compressed(send: Callable) -> Callable:
    """What ``send`` gives, with the segments of a row compressed."""

    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        sent = send(key, rows, answers)
        data = pa.array([pa.compress(x, _CODEC, asbytes=True) for x in sent.column("bytes").to_pylist()], pa.binary())
        return sent.set_column(sent.schema.get_field_index("bytes"), "bytes", data)

    return run


def _resolve(key: tuple, rows: pa.Table) -> pa.Table:
    """A shard: the least doc_id of each window of each segment, in runs, to those who sent it."""
    sizes = [_unzipped(x, "<u2") for x in rows.column("sizes").to_pylist()]
    raw = b"".join(
        pa.decompress(x, int(n.sum()), _CODEC, asbytes=True) for x, n in zip(rows.column("bytes").to_pylist(), sizes, strict=True)
    )
    docs = np.concatenate([_unzipped_steps(x, "<i8") for x in rows.column("least").to_pylist()])
    ends = np.cumsum([len(x) for x in sizes])
    size = np.concatenate(sizes).astype(np.int64)
    begin = np.cumsum(size) - size
    equal, new = _equal_strings(np.frombuffer(raw, np.uint8), begin, size)
    own = np.empty(len(size), np.int64)
    own[equal] = np.cumsum(new) - 1
    asked = zip(rows.column("bucket").to_pylist(), np.split(own, ends[:-1]), strict=True)
    docs = np.minimum.reduceat(docs[equal], np.flatnonzero(new))
    begin, size = begin[equal[new]], size[equal[new]]
    windows = size - LENGTH + 1
    segment = np.repeat(np.arange(len(size)), windows)
    by_window = docs[segment]
    alike = _anchored_alike(np.frombuffer(raw, np.uint8), begin, windows)
    if alike.any():
        s = np.frombuffer(_joined(raw, begin[alike], size[alike]), np.uint8)
        looked = np.flatnonzero(alike[segment])
        least = by_window[looked]
        begin = np.cumsum(size[alike]) - size[alike]
        first = np.cumsum(windows[alike]) - windows[alike]
        position = np.arange(len(looked)) - np.repeat(first - begin, windows[alike])
        is_window = np.full(len(s), -1, np.int32)
        is_window[position] = np.arange(len(position))
        order = suffix_array(s, LENGTH)
        order = order[is_window[order] >= 0]
        prefix = permuted_prefixes(s, order, LENGTH)
        group = np.flatnonzero(np.concatenate([[True], prefix[order[1:]] < LENGTH]))
        number = is_window[order]
        lowest = np.minimum.reduceat(least[number], group)
        by_window[looked[number]] = np.repeat(lowest, np.diff(np.append(group, len(order))))
    starts = np.flatnonzero(np.concatenate([[True], (by_window[1:] != by_window[:-1]) | (segment[1:] != segment[:-1])]))
    lengths = np.diff(np.append(starts, len(by_window)))
    run_doc = by_window[starts]
    runs = np.bincount(segment[starts], minlength=len(size))
    run_first = np.cumsum(runs) - runs
    out = []
    for bucket, own in asked:
        n = runs[own]
        take = np.repeat(run_first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append(
            (
                bucket,
                key[0].as_py(),
                _zipped(n.astype("<u2")),
                _zipped(lengths[take].astype("<u2")),
                _zipped(run_doc[take].astype("<i8")),
            )
        )
    return _arrow(out, FOUND)


def _cut(bucket: _Bucket, found: pa.Table, occurrences: np.ndarray) -> np.ndarray:
    """Which bytes of the bucket go."""
    begins, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    columns = (found.column(c).to_pylist() for c in ("shard", "counts", "lengths", "docs"))
    order = np.argsort(occurrences[:, 0], kind="stable")
    occurrences = occurrences[order]
    for shard, counts, lengths, docs in zip(*columns, strict=True):
        lo, hi = np.searchsorted(occurrences[:, 0], [shard, shard + 1])
        _, place, start, doc = occurrences[lo:hi].T
        n = _unzipped(counts, "<u2").astype(np.int64)
        size, least = _unzipped(lengths, "<u2").astype(np.int64), _unzipped(docs, "<i8")
        first = np.cumsum(n) - n
        offset = np.cumsum(size) - size
        offset -= np.repeat(offset[first], n)
        times = n[place]
        run = np.repeat(first[place] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        goes = least[run] < bucket.ids[np.repeat(doc, times)]
        a = (np.repeat(start, times) + offset[run])[goes]
        b = a + size[run][goes] + LENGTH - 1
        begins.append(a)
        ends.append(b)
    # a byte goes if more of the runs before it have begun than ended
    marks = np.zeros(len(bucket.data) + 1, np.int32)
    at, times = np.unique(np.concatenate(begins), return_counts=True)
    marks[at] += times.astype(np.int32)
    at, times = np.unique(np.concatenate(ends), return_counts=True)
    marks[at] -= times.astype(np.int32)
    return np.cumsum(marks, dtype=np.int32)[:-1] > 0


def _finish(ranges: int, shards: int, schema: pa.Schema, columns: list[str]) -> Callable:
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        bucket = _Bucket(rows)
        marked = answers.filter(pc.is_valid(answers.column("hashes")))
        found = answers.filter(pc.is_valid(answers.column("counts")))
        goes = np.zeros(len(bucket.data), bool)
        if found.num_rows:
            _, occurrences = bucket.shared(marked, ranges, shards)
            goes = _cut(bucket, found, occurrences)
        n_removed = np.diff(np.concatenate([[0], np.cumsum(goes)])[np.append(bucket.start, len(goes))])
        # a run of removed bytes ends with its document
        begins = goes.copy()
        begins[1:] &= ~goes[:-1]
        inner = bucket.start[bucket.size > 0]
        begins[inner] = goes[inner]
        starts = np.flatnonzero(begins)
        first, last = np.searchsorted(starts, bucket.start), np.searchsorted(starts, bucket.end)
        stays, whole = bucket.data[~goes].tobytes(), np.cumsum(bucket.size - n_removed)
        kept = [stays[a:b] for a, b in zip((whole - bucket.size + n_removed).tolist(), whole.tolist(), strict=True)]
        made = {
            "n_bytes": pa.array(bucket.size),
            "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(last - first, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        }
        if "kept" in schema.names:
            made["kept"] = pa.array([x.decode(errors="ignore") for x in kept], pa.string())
        if "spans" in schema.names:
            ends = np.flatnonzero(goes & ~np.concatenate([(goes & ~begins)[1:], [False]])) + 1
            spans = [
                [{"start": x - at, "end": y - at} for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                for at, a, b in zip(bucket.start.tolist(), first.tolist(), last.tolist(), strict=True)
            ]
            made["spans"] = pa.array(spans, schema.field("spans").type)
        return pa.table([made[c] if c in made and c not in columns else bucket.rows.column(c) for c in schema.names], schema=schema)

    return run


def remove_repeats(
    documents: DataFrame,
    columns: list[str] | None = None,
    outputs: tuple[str, ...] = ("kept", "spans"),
    hot_buckets: int = HOT_BUCKETS,
    hot_segments: int = HOT_SEGMENTS,
) -> DataFrame:
    """Every row's ``doc_id`` and the ``columns`` named, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept_sha256`` and, as asked by ``outputs``, ``kept`` (the text that stays; characters cut in
    two go) and ``spans`` (of removed bytes).

    A null text is empty. Rows of one doc_id don't remove from each other, however equal; rows
    without a doc_id are left whole and remove nothing. Texts under LENGTH bytes are kept. An empty
    table gives no rows. Columns not named are not used; those named must not clash with the results.
    """
    spark = documents.sparkSession
    columns = [c for c in (columns or []) if c not in ("doc_id", "text")]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *columns)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-total // BUCKET_BYTES))
    ranges, shards = max(least, -(-total // RANGE_BYTES)), max(least, -(-total // SHARD_BYTES))
    limit = "spark.sql.sources.bucketing.maxBuckets"
    if buckets > int(spark.conf.get(limit, "100000")):
        spark.conf.set(limit, str(buckets))  # Spark's limit is a guard against slips, and reading needs it as well
    name = f"plenaria_buckets_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/plenaria/{name}"
    (
        rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
        .repartition(buckets, "bucket")
        .write.bucketBy(buckets, "bucket")
        .sortBy("bucket")
        .option("path", path)
        .option("compression", "zstd")
        .saveAsTable(name)
    )
    forget_at_exit(spark, path, name)
    dealt = spark.table(name)
    texts = dealt.select("bucket", "doc_id", "text")

    anchors = texts.groupBy("bucket").applyInArrow(_anchors(ranges), RANGED)
    answers = scratch(anchors.groupBy("range").applyInArrow(_answers(hot_buckets, hot_segments), ANSWERED), "answers")
    sent = texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_compressed(_send(ranges, shards)), SENT)
    found = sent.groupBy("shard").applyInArrow(_resolve, FOUND)

    both = answers.unionByName(found, allowMissingColumns=True)
    fields = [f for f in dealt.schema.fields if f.name in ("doc_id", *columns)]
    schema = T.StructType([*fields, *DIGEST.fields, *(OUTPUTS[x] for x in outputs)])
    work = _finish(ranges, shards, to_arrow_schema(schema), columns)
    own = dealt.select("bucket", "doc_id", "text", *columns)
    return own.groupBy("bucket").cogroup(both.groupBy("bucket")).applyInArrow(work, schema)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that a document of smaller id says as well, in strings of 50 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"), outputs=())


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, LATERAL unnest(range(greatest(length(h) // 2 - 49, 0))) t(i)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
f AS (SELECT w.doc_id, i FROM w JOIN m USING (s) WHERE least < w.doc_id),
g AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM f),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, span),
k AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM r),
c AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last,
  string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(from_hex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
