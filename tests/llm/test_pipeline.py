"""Every stage of the corpus pipeline against brute force, on its own input."""

import hashlib
import re

import corpus_pipeline as P
from plenaria.llm import chat
from pyspark.sql import functions as F
from tests.llm.test_operators import fingerprint, groups, leaked, removed


def read(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stage_order():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]


def test_quality_stage(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    docs = read(spark, d)
    kept = P.quality(spark, docs, d)
    assert kept.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    junk = [i for i, q in labels.items() if q == 0]
    assert sum(i in ids for i in clean) / len(clean) > 0.98 and sum(i in ids for i in junk) / len(junk) < 0.1


def one_of_each(rows):
    """The rows that stay, by brute force over row numbers: (doc_id, text, source)."""
    group = groups({k: fingerprint(r[1]) for k, r in enumerate(rows)})
    best = {}
    for k, (i, t, s) in enumerate(rows):
        rank = (i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), s)
        if group[k] not in best or rank < best[group[k]][0]:
            best[group[k]] = rank, (i, t, s)
    return sorted((r for _, r in best.values()), key=str)


def test_near_duplicate_stage(spark, sf):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    cases = [
        [(5, a, "s"), (5, b, "s")],
        [(3, a, "s"), (5, a, "s"), (5, b, "s")],
        [(3, a, "s"), (5, a, "s"), (5, b, "s"), (9, c, "s"), (9, c, "s")],
        [(None, a, "s"), (None, a, "t"), (None, b, "s"), (7, b, "s"), (None, None, "s"), (8, "", "s"), (8, " ", "s")],
        [(1, a, "t"), (1, a, "s"), (1, a, None), (2, c, "s"), (2, d, "s"), (None, d, "s")],
    ]
    together = [r for case in cases for r in case]
    for rows in (*cases, together):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"_digest": F.lit(1), "n": F.create_map(F.lit("k"), F.lit(1))})
        kept = P.near_duplicates(spark, docs, sf)
        assert kept.columns == docs.columns
        got = sorted(((r.doc_id, r.text, r.source) for r in kept.collect()), key=str)
        want = one_of_each([(i, t, "" if s is None else s) for i, t, s in rows])
        assert [r[:2] for r in got] == [r[:2] for r in want]
    # what stays of a case does not depend on other rows that aren't near any of it
    apart = cases[0] + [(9, c, "s"), (9, c, "s")]
    kept = P.near_duplicates(spark, spark.createDataFrame(apart, "doc_id long, text string, source string"), sf).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, a), (5, b), (9, c)])
    docs = read(spark, sf)
    docs = docs.unionByName(docs.filter("doc_id < 3")).unionByName(docs.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    kept = P.near_duplicates(spark, docs, sf)
    want = one_of_each([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert sorted(((r.doc_id, r.text, r.source) for r in kept.collect()), key=str) == want and kept.columns == docs.columns


def test_passage_stage(spark, sf):
    docs = read(spark, sf).limit(120).withColumns({"kept": F.lit("k"), "n_bytes": F.lit(1), "bucket": F.lit(None).cast("int")})
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = P.repeated_passages(spark, docs, sf)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    want = {r[0]: r[1] - r[2] for r in removed(rows)}
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(want) and all(r.n_chars == len(r.text) and r.kept == "k" for r in got.values())
    assert all(0 <= want[i] - len(r.text.encode()) <= 8 for i, r in got.items())


def test_leak_stage(spark, sf):
    docs = read(spark, sf)
    kept = {r.doc_id for r in P.benchmark_leaks(spark, docs, sf).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    holding = {i for i, t in rows if any(s in t for _, s in items)}
    assert holding and not holding & kept and kept | holding == {i for i, _ in rows}
    assert {i for i, _ in leaked([r for r in rows if r[0] in sorted(holding)[:3]], items[:20])} <= holding
    # texts are judged by themselves, whatever their id
    texts = [(None, items[0][1]), (1, items[0][1]), (1, "nothing of it"), (None, "nothing"), (2, None)]
    mixed = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted([tuple(r) for r in P.benchmark_leaks(spark, mixed, sf).collect()], key=str) == sorted([(1, "nothing of it"), (None, "nothing"), (2, None)], key=str)


def test_empty_and_null_documents(spark, sf):
    docs = read(spark, sf)
    for rows in (docs.limit(0), docs.limit(3).withColumns({"text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, rows, sf)
            assert out.columns == docs.columns, name
            assert out.count() <= rows.count()
        assert P.packing(spark, rows, sf).count() == rows.count()


def test_very_long_documents(spark, sf):
    """A text of megabytes: its copy goes, what it shares with a smaller id is cut, a leak in its end is found."""
    docs = read(spark, sf).limit(5)
    words = [f"w{i}" for i in range(200_000)]
    long = " ".join(words)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("length(text) > 80").orderBy("item_id").first().text
    made = [(-3, long), (-2, long), (-1, "x " * 90 + " ".join(words[:50_000]) + " end"), (-4, f"{long} {item}")]
    rows = docs.limit(1).select(*(c for c in docs.columns if c not in ("doc_id", "text")))
    rows = docs.unionByName(spark.createDataFrame(made, "doc_id long, text string").crossJoin(rows).select(*docs.columns))
    near = {r.doc_id: r.text for r in P.near_duplicates(spark, rows.filter("doc_id IN (-3, -2) OR doc_id >= 0"), sf).collect()}
    assert near[-3] == long and -2 not in near
    cut = {r.doc_id: r.text for r in P.repeated_passages(spark, rows.filter("doc_id <> -4"), sf).collect()}
    assert cut[-3] == long and cut[-2] == "" and cut[-1] == "x " * 90 + "end"
    clean = {r.doc_id for r in P.benchmark_leaks(spark, rows, sf).collect()}
    assert clean >= {-3, -2, -1} and -4 not in clean
    packed = P.packing(spark, rows.filter("doc_id = -3"), sf)
    assert packed.agg(F.sum("length")).first()[0] > 200_000 and packed.filter("length > 2048").count() == 0


def test_run_packs_what_is_kept(spark, sf):
    out = P.run(spark, sf)
    assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_guard_and_registry():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")) == list(range(1, 13))
    assert "op4_chat_formatting" in e.oracle_sql() and chat.OP4_SQL
