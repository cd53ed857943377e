"""Counts of words, sentences and syllables of many texts at once, as numpy arrays over their code points.

The rules are those of ``complexity``'s expressions, whose Unicode classes (word characters, white space) are tables here.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

#: Characters that are worked on at once; a longer text is a piece of its own.
PIECE = 1 << 20
COUNTS = ("tokens", "distinct", "token_chars", "sentences", "sentence_words", "long_sentences", "lexicon", "syllables", "hard", "words")
DDL = ", ".join(f"{c}: long" for c in COUNTS)
VOWELS = frozenset("aeiouy" + "".join(map(chr, [*range(0xE0, 0xE7), *range(0xE8, 0xF0), *range(0xF2, 0xF7), *range(0xF8, 0xFE), 0xFF, 0x153])))

_SPACE, _STOP, _WORD, _LETTER, _KEPT, _VOWEL = (np.uint8(1 << i) for i in range(6))
#: Stands behind each text: no character, white space and the end of a sentence.
_END = 0x110000
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and word characters that their category doesn't tell: joiners, and letters in circles and squares.
_ALSO_WORD = [0x200C, 0x200D, *range(0x24B6, 0x24EA), *range(0x1F130, 0x1F14A), *range(0x1F150, 0x1F16A), *range(0x1F170, 0x1F18A)]
_DOTTED_I = 0x130  # in lower case an i and a dot above it, which ends the vowels
_SIGNS = (0xD7, 0xF7)  # in the range of a token's letters, but no word characters


@cache
def _classes() -> np.ndarray:
    """The classes of each code point, as bits."""
    found = np.zeros(_END + 1, np.uint8)
    for i in (*range(0x32400), *range(0xE0000, 0xE0200)):  # others are unassigned or private
        c = chr(i)
        kind = unicodedata.category(c)
        if kind[0] in "LM" or kind in ("Nd", "Nl", "Pc"):
            found[i] |= _WORD
        if kind[0] in "LNS" and not VOWELS.isdisjoint(c.lower()):
            found[i] |= _VOWEL
    found[_ALSO_WORD] |= _WORD
    found[[*_SPACES, _END]] |= _SPACE
    found[[*map(ord, ".!?"), _END]] |= _STOP
    found[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] |= _LETTER
    found[(found & (_WORD | _SPACE) > 0)] |= _KEPT
    found[ord("'")] |= _KEPT
    return found


_LOWER = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 and ord(chr(i).lower()) < 256 else i for i in range(256)], np.uint8)


def _starts(inside: np.ndarray) -> np.ndarray:
    """Where runs of ``inside`` begin."""
    return np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))


def _signed_tokens(letter: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Marks of the characters in tokens of a text with signs among its letters, and of where a token begins, by the
    expression's own search: from the leftmost boundary to the last one of the run."""
    edge = np.concatenate([[word[0]], word[1:] != word[:-1], [word[-1]]])
    found = np.zeros(len(letter), np.uint8)
    for s in _starts(letter).tolist():
        e = s
        while e < len(letter) and letter[e]:
            e += 1
        while s < e - 1:
            end = next((j for j in range(e, s + 1, -1) if edge[j]), None) if edge[s] else None
            if end is None:
                s += 1
                continue
            found[s:end], found[s] = 1, 2
            s = end
    return found


def _piece(texts: list[str]) -> np.ndarray:
    """The counts of each text, a row each."""
    end = _END.to_bytes(4, "little")
    points = np.frombuffer(b"".join([x for t in texts for x in (t.encode("utf-32-le", "surrogatepass"), end)]), np.uint32)
    kind = _classes()[points]
    n = len(texts)
    ends = np.flatnonzero(points == _END)
    out = np.zeros((n, len(COUNTS)), np.int64)
    per = lambda at, weights=None: np.bincount(np.searchsorted(ends, at), weights=weights, minlength=n)

    letter, word = (kind & _LETTER) > 0, (kind & _WORD) > 0
    first = _starts(letter)
    after = np.flatnonzero(letter & ~np.concatenate([letter[1:], [False]])) + 1
    whole = (after - first > 1) & ~word[after] & ~np.where(first > 0, word[first - 1], False)
    marks = np.zeros(len(points) + 1, np.int8)
    marks[first[whole]] += 1
    marks[after[whole]] -= 1
    inside = np.cumsum(marks[:-1]).astype(bool)
    signed = set(np.searchsorted(ends, np.flatnonzero((points == _SIGNS[0]) | (points == _SIGNS[1]))).tolist())
    low = np.where(inside, _LOWER[np.minimum(points, 255)], np.uint8(32)).tobytes()
    at = 0
    for i, stop in enumerate(ends.tolist()):
        if i in signed:
            found = _signed_tokens(letter[at:stop], word[at:stop])
            chars = _LOWER[np.minimum(points[at:stop], 255)].tobytes()
            cuts = np.flatnonzero(found == 2).tolist()
            own = [chars[s : s + 1 + int(np.argmax(np.append(found[s + 1 :] != 1, True)))] for s in cuts]
        else:
            own = low[at:stop].split()
        out[i, :3] = len(own), len(set(own)), sum(map(len, own))
        at = stop + 1

    said = _starts((kind & (_SPACE | _STOP)) == 0)
    sentence = np.cumsum((kind & _STOP) > 0)[said]
    opens = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(said) else np.empty(0, np.int64)
    out[:, 3] = per(said[opens])
    out[:, 4] = per(said)
    out[:, 5] = per(said[opens[np.diff(np.append(opens, len(said))) > 2]])

    out[:, 9] = per(_starts((kind & _SPACE) == 0))

    kept = (kind & _KEPT) > 0
    kind, points = kind[kept], points[kept]
    ends = np.flatnonzero(points == _END)
    vowel = (kind & _VOWEL) > 0
    before = np.concatenate([[False], vowel[:-1] & (points[:-1] != _DOTTED_I)])
    groups = (vowel & ~before).astype(np.int64)
    words = _starts((kind & _SPACE) == 0)
    if len(words):
        groups = np.add.reduceat(groups, words)
        out[:, 6] = per(words)
        out[:, 7] = per(words, np.maximum(groups, 1))
        out[:, 8] = per(words[groups >= 3])
    return out


def counted(texts: pa.Array) -> pa.StructArray:
    """A struct of COUNTS for each text, null for a null one."""
    texts = texts.cast(pa.large_string())
    rows = np.zeros((len(texts), len(COUNTS)), np.int64)
    held, at, size = [], 0, 0
    for i, value in enumerate(texts):
        text = value.as_py() or ""
        if held and size + len(text) > PIECE:
            rows[at:i] = _piece(held)
            held, at, size = [], i, 0
        held.append(text)
        size += len(text)
    if held:
        rows[at:] = _piece(held)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(COUNTS))], list(COUNTS), mask=texts.is_null())
