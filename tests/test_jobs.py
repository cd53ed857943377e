"""The jobs: growing input, batches cut off, repeated runs, parts of the output, and the command line."""

import os
import subprocess
import sys

import pytest

from jobs import base, speech_ingest
from jobs.party_report import party_report

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = {"orders": "orders", "customers": "customer", "nations": "nation", "embeddings": "embeddings"}


def rows(df):
    return sorted(map(str, df.collect()))


def test_party_report_replaces_the_years_it_reports(spark, sf, tmp_path):
    paths = {k: f"{sf}/{t}.parquet" for k, t in TABLES.items()} | {"out": str(tmp_path / "out")}
    want = rows(party_report(spark, **paths))
    whole = party_report(spark, **paths).collect()
    assert sorted(map(str, whole)) == want
    years = sorted({r.year for r in whole})
    assert f"year={years[0]}" in os.listdir(paths["out"])
    # A run for some years leaves the others, and compares with what came before its own.
    assert rows(party_report(spark, **paths, start_year=years[-2], end_year=years[-2])) == want
    part = party_report(spark, **(paths | {"out": str(tmp_path / "part")}), start_year=years[2], end_year=years[3])
    assert rows(part) == sorted(str(r) for r in whole if r.year in years[2:4])
    assert part.filter("sentiment_change IS NOT NULL").count() == part.count() > 0
    # Reports of speeches without vectors, and of none at all.
    none = str(tmp_path / "none")
    spark.read.parquet(paths["embeddings"]).limit(0).write.parquet(none)
    bare = party_report(spark, **(paths | {"embeddings": none, "out": str(tmp_path / "bare")}))
    assert bare.count() == len(whole) == bare.filter("n_vectors = 0 AND nearest_party IS NULL AND velocity IS NULL").count()
    nothing = str(tmp_path / "nothing")
    spark.read.parquet(paths["orders"]).limit(0).write.parquet(nothing)
    assert party_report(spark, **(paths | {"orders": nothing, "out": str(tmp_path / "empty")})).count() == 0


LONG = "The committee gave New York great support in failure. " * 10


@pytest.fixture
def folders(spark, tmp_path):
    orders = str(tmp_path / "orders")
    spark.range(10).selectExpr("id AS o_orderkey", "make_timestamp(2000 + CAST(id AS INT) % 3, 5, 1, 0, 0, 0) AS o_orderdate").write.parquet(orders)
    return {k: str(tmp_path / k) for k in ("documents", "out", "checkpoint")} | {"orders": orders}


def add(spark, folders, new):
    df = spark.createDataFrame([(*r, "more") for r in new], "doc_id long, text string, lang string, source string, batch string")
    df.coalesce(1).write.mode("append").parquet(folders["documents"])


def test_speech_ingest_takes_only_what_is_new(spark, folders):
    add(spark, folders, [(1, LONG, "en", "A"), (2, "short one", "de", "B"), (2, "short one", "de", "B"), (2, "another", "en", "B"), (None, "nobody's", None, None)])
    first = speech_ingest.speech_ingest(spark, **folders)
    got = {r.speech_id: r for r in first.collect()}
    assert len(got) == first.count() == 3 and got["1"].year == 2001 and got["1"].country_code == "EN"
    assert (got["1"].n_words, got["1"].n_topics, got["1"].sentiment) == (90, 3, 0.333333)
    assert got["2"].language == "de" and got["2"].sentiment is None and got["2"].n_topics == 0
    before, files = rows(first), {f for _, _, f in os.walk(folders["out"]) for f in f if f.startswith("part-")}
    assert rows(speech_ingest.speech_ingest(spark, **folders)) == before
    # The first writer stays; ids and texts that are known aren't added again; what was written isn't written again.
    add(spark, folders, [(1, "changed", "fr", "Z"), (3, None, "en", "A"), (None, "nobody's", None, None), (None, None, None, None), (99, "no order", "en", "A")])
    second = speech_ingest.speech_ingest(spark, **folders)
    want, now = rows(second), {r.speech_id: r for r in second.collect()}
    assert set(before) < set(want) and len(want) == 6
    assert now["3"].batch == 1 and now["3"].n_words == 0 and now["3"].ttr is None and now["99"].year is None
    assert files < {f for _, _, f in os.walk(folders["out"]) for f in f}
    # A file of known ids only adds nothing.
    add(spark, folders, [(3, "again", "en", "A")])
    assert rows(speech_ingest.speech_ingest(spark, **folders)) == want
    # A checkpoint that was lost costs work, no rows.
    again = speech_ingest.speech_ingest(spark, **(folders | {"checkpoint": folders["checkpoint"] + "-new"}))
    assert rows(again) == want


def test_speech_ingest_goes_on_after_a_batch_that_was_cut_off(spark, folders, monkeypatch):
    for i in range(4):
        add(spark, folders, [(i, LONG, "en", "A"), (i + 1, "short", "en", "B")])
    made, calls = speech_ingest._speeches, []

    def cut_off(*args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("cut off")
        return made(*args)

    monkeypatch.setattr(speech_ingest, "_speeches", cut_off)
    with pytest.raises(Exception, match="cut off"):
        speech_ingest.speech_ingest(spark, **folders, files_per_batch=1)
    there = spark.read.schema(speech_ingest.SPEECHES).parquet(folders["out"])
    assert there.select("batch").distinct().count() == 2
    whole = speech_ingest.speech_ingest(spark, **folders, files_per_batch=1)
    assert sorted(r.speech_id for r in whole.collect()) == ["0", "1", "2", "3", "4"]
    assert {r.batch for r in whole.collect()} == {0, 1, 2, 3}


def test_jobs_from_the_command_line(sf, tmp_path):
    settings = base.config(f"{ROOT}/jobs/party_report.toml")
    assert settings["start_year"] == 0 and set(base.config(f"{ROOT}/jobs/speech_ingest.toml")) == {"documents", "orders", "out", "checkpoint", "least_words", "files_per_batch"}
    given = [f"{k}={sf}/{t}.parquet" for k, t in TABLES.items()] + [f"out={tmp_path}/out", "start_year=1997"]
    argv = [x for s in given for x in ("--set", s)]
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-m", "jobs.party_report", *argv], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows written to" in done.stderr and all(n.startswith("year=") and n >= "year=1997" for n in os.listdir(tmp_path / "out") if n[0] not in "._")
