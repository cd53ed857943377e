"""The prefix trie against a version that walks dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from plenaria.llm import common, trie

CONV = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    members, at_end = defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        said = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(said) + 1):
            members[said[:d]].append(c)
        at_end[said].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in members:
        own = (len(members[n]) - 1) * len(WORD.findall(n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += own
    return sorted(
        (
            min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, sorted(at_end[n]))).encode()).hexdigest(),
        )
        for n in members
    )


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: r[:2])


ODD = [
    (None, 0, "user", "nobody's"), (0, None, "user", "first"), (0, 0, "user", "then"), (0, 0, "user", "then"), (0, 0, None, None), (0, 5, "assistant", "a b"),
    (1, 0, "user", "hello there"), (2, 0, "user", ""), (2, 1, "", "x" * 50_000 + " y"), (3, 0, "user", "then"), (3, -1, "user", "first"), (3, 9, "user", "a\x0bb c d"),
    (-1, 0, "user", "low"), (-20, 0, "user", "base"), (-39, 0, "user", "own"), (-39, 1, "user", "own"), (-39, 1 << 60, "user", "late"),
    (20, 0, "user", "a"), (21, 0, "user", "b"), (21, 1, "user", "c"), (21, 2, "user", "d"), (21, 3, "user", "e"), (45, 0, "user", "a:1"), (45, 1, "us", "er:a"),
]


def test_odd_rows(spark):
    assert found(trie.trie(spark.createDataFrame(ODD, CONV))) == brute(ODD)


def test_no_conversations_and_other_columns(spark):
    assert found(trie.trie(spark.createDataFrame([], CONV))) == []
    rows = [(i, t, "user", f"t{t}") for i in (7, 8, 8) for t in (0, 1, 1, 2)]
    more = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], CONV + ", n long, key string, path string")
    assert found(trie.trie(more)) == brute(rows)


@pytest.mark.parametrize("seed, convs, said", [(1, 120, 2), (3, 150, 5)])
def test_random_tries_in_small_blocks(spark, monkeypatch, seed, convs, said):
    """Long and short conversations, most sharing turns, summed in blocks of three places and chunks of two ids."""
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "CHUNK_IDS", 2)
    monkeypatch.setattr(common, "HOT_VALUES", 8)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-100, 400), convs):
        for turn in range(rng.choice([1, 2, 3, 5, 8, 30])):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if said > 3 else "user", " ".join(["w"] * rng.randrange(said))))
    rng.shuffle(rows)
    assert found(trie.trie(spark.createDataFrame(rows, CONV).repartition(3))) == brute(rows)


def test_groups_of_copies(spark, monkeypatch):
    """A third of conversations alike, their ids spread over chunks and ranges; one path holds most turns."""
    monkeypatch.setattr(trie, "CHUNK_IDS", 64)
    rows = [(c, t, "user", f"turn {t}" if c % 3 else f"turn {t} of {c}") for c in range(240) for t in range(4)]
    rows += [(1000, t, "user", f"long {t}") for t in range(400)]
    monkeypatch.setattr(trie, "BLOCK", 100)
    assert found(trie.trie(spark.createDataFrame(rows, CONV).repartition(4))) == brute(rows)


def test_all_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(trie.op12_prefix_trie(spark, sf)) == brute(rows)
