"""The top-k overlap join against counting all pairs, and how many pairs it counts where one item is frequent."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plenaria.operators import overlap

LEFT, RIGHT = "a struct<name:string,party:string>, item string, lo long", "b struct<name:string,party:string>, item string, hi long"


def top(left, right, k):
    return overlap.top_overlaps(left, right, k, F.expr("a.party <> b.party"), [F.col("a"), F.col("b")])


def brute(left, right, k):
    sets, shared = defaultdict(list), defaultdict(int)
    for b, item, hi in right:
        sets[item].append((b, hi))
    for a, item, lo in left:
        for b, hi in sets[item]:
            if a[1] != b[1] and lo < hi:
                shared[a, b] += 1
    return sorted(((a, b, n) for (a, b), n in shared.items()), key=lambda r: (-r[2], r[0], r[1]))[:k]


def people(rng, n, items, each, start=0):
    """Owners with sets of uneven sizes; the first item is everybody's, the second that of a third."""
    found = []
    for i in range(start, start + n):
        own = {0} | ({1} if i % 3 == 0 else set()) | {min(int(rng.expovariate(4 / items)), items - 1) + 2 for _ in range(rng.randrange(*each))}
        found += [((f"n{i:04}", f"P{i % 4}"), f"t{x}", i) for x in own]
    return found


@pytest.mark.parametrize("seed, items, each, k, block", [(1, 40, (1, 30), 10, 1024), (2, 400, (1, 8), 20, 7), (3, 5, (1, 3), 5, 16), (4, 3000, (1, 3), 3, 50)])
def test_equals_all_pairs(spark, monkeypatch, seed, items, each, k, block):
    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(overlap, "SEEDS", 8)
    rng = random.Random(seed)
    both = people(rng, 150, items, each)
    left = [r for r in both if r[2] % 2]
    found = top(spark.createDataFrame(left, LEFT), spark.createDataFrame(both, RIGHT), k)
    assert [(tuple(r.a), tuple(r.b), r.overlap) for r in found.collect()] == brute(left, both, k)


def test_fewer_pairs_than_asked_for(spark):
    left = [(("x", "P"), "t", 1), (("y", "P"), "u", 2)]
    right = [(("z", "Q"), "t", 5), (("z", "Q"), "u", 5), (("w", "P"), "t", 9), (("v", "Q"), "t", 1)]
    found = top(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), 10)
    assert [(r.a.name, r.b.name, r.overlap) for r in found.collect()] == [("x", "z", 1), ("y", "z", 1)]
    none = spark.createDataFrame([], LEFT)
    assert top(none, spark.createDataFrame(right, RIGHT), 10).count() == 0


def test_a_frequent_item_makes_few_candidates(spark, monkeypatch):
    """2,000 owners with sparse sets; one item is everybody's and one that of a third. All pairs that share an item
    are about two million; those that can reach the bound are a small part."""
    rng = random.Random(5)
    both = people(rng, 2000, 4000, (1, 12))
    # Some sets that are much alike, and not the largest.
    both += [((f"m{i:04}", f"P{i % 4}"), f"c{i % 5}-{x}", 5000 + i) for i in range(40) for x in range(10)]
    left = spark.createDataFrame(both, LEFT)
    right = spark.createDataFrame(both, RIGHT)
    made, counts = overlap.candidates, []

    def noted(*args):
        pairs = made(*args)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(overlap, "candidates", noted)
    assert [(tuple(r.a), tuple(r.b), r.overlap) for r in top(left, right, 20).collect()] == brute(both, both, 20)
    assert sum(counts) < 40_000
