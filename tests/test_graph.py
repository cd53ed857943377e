"""Sources, the graph store, extraction, vectors and the command line on original fixtures."""

import argparse
import functools
import json
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plenaria import cli, schemas
from plenaria.operators import evaluation, extraction, graph, results, vectors
from plenaria.plans import flows
from plenaria.sources.posts import PostSource
from plenaria.sources.tei import TranscriptSource

TEI = """<?xml version="1.0" encoding="UTF-8"?>
<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="x"><teiHeader>
<fileDesc><titleStmt><title>Sitting</title><meeting n="S1"/></titleStmt></fileDesc>
<profileDesc><settingDesc><setting><date when="2021-09-15"/></setting></settingDesc>
<langUsage><language ident="de"/></langUsage><textClass><catRef target="#corpus.type.covid"/></textClass>
<particDesc><listPerson>
<person xml:id="MüllerA"><persName><forename>Anna</forename><surname>Müller</surname></persName><roleName>Chair</roleName>
 <affiliation role="observer" ref="#none"/><affiliation role="member" ref="#pa"/></person>
<person xml:id="KlugB"><persName><forename>Bert</forename><surname>Klug</surname></persName><affiliation role="member" ref="#pb"/></person>
</listPerson><listOrg><org xml:id="pa"><orgName> Alpha Party </orgName></org></listOrg></particDesc></profileDesc></teiHeader>
<text><body><div>
<u who="#MüllerA" xml:id="u1"><seg>One <note>two</note> three</seg><seg>four five six.</seg></u>
<u who="#KlugB" xml:id="u2">No segments but enough words in it.</u>
<u who="#KlugB" xml:id="u3"><seg>Short.</seg></u>
<u who="#Guest"><seg>An unknown guest says some words too.</seg></u>
<u><seg>Nobody says this although it is long enough.</seg></u>
</div></body></text></TEI>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("tei")
    (d / "year").mkdir()
    (d / "year" / "Session-DE_2021-09-15.xml").write_text(TEI, encoding="utf-8")
    (d / "corpus-root.xml").write_text(TEI, encoding="utf-8")
    (d / "bad.xml").write_text("<TEI><unclosed>", encoding="utf-8")
    (d / "other.xml").write_text("<html/>", encoding="utf-8")
    return str(d)


def test_transcripts(spark, folder):
    source = TranscriptSource("de", 5)
    got = {r.doc_id: r for r in source.load(spark, folder).collect()}
    assert set(got) == {"u1", "u2", "S1_Guest_3"}
    u1 = got["u1"]
    assert (u1.text, u1.speaker_name, u1.party, u1.role) == ("One two three four five six.", "Anna Müller", "Alpha Party", "Chair")
    assert (str(u1.date), u1.language, u1.country_code, u1.subcorpus, u1.session_id) == ("2021-09-15", "de", "DE", "COVID", "S1")
    assert got["u2"].party == "pb" and u1.metadata == {"token_count": "6"}
    assert (got["S1_Guest_3"].speaker_name, got["S1_Guest_3"].party, got["S1_Guest_3"].role) == ("Guest", "Unknown", "MP")
    assert source.load(spark, folder).schema.names == source.schema().names
    assert TranscriptSource("de", 1000).load(spark, folder).count() == 0
    assert TranscriptSource("de", 5, ["OTHER"]).load(spark, folder).count() == 0
    assert [r.path.rpartition("/")[2] for r in source.errors(spark, folder).collect()] == ["bad.xml"]
    with pytest.raises(FileNotFoundError):
        source.load(spark, folder + "/missing")


def test_posts(spark, tmp_path):
    lines = [
        {"id": "1", "text": "a b", "author_id": "x", "created_at": "2022-03-01T10:00:00Z", "lang": "en", "public_metrics": {"like_count": 3}},
        {"id": "2", "text": "c", "author_id": "stranger", "created_at": "2022-03-01T10:00:00Z"},
    ]
    (tmp_path / "p.ndjson").write_text("\n".join([*map(json.dumps, lines), "not json"]))
    handles = spark.createDataFrame([Row(author_id="x", speaker_id="s", name="N", party="P", role="MP")])
    got = PostSource("de", handles).load(spark, str(tmp_path)).collect()
    assert [(r.doc_id, str(r.date), r.token_count, r.metadata["like_count"]) for r in got] == [("tw_1", "2022-03-01", 2, "3")]


def test_store_is_idempotent_and_first_writer_wins(spark, folder, tmp_path):
    store = graph.GraphStore(spark, str(tmp_path / "g"))
    documents = TranscriptSource("de", 5).load(spark, folder, trace=True)
    store.upsert_documents(documents)
    before = {t: sorted(map(str, store.read(t).collect())) for t in ("speeches", "politicians", "parties", "delivered_speech", "member_of")}
    store.upsert_documents(documents.withColumn("speaker_name", F.lit("Changed")))
    assert before == {t: sorted(map(str, store.read(t).collect())) for t in before}
    assert len(before["speeches"]) == 3 and store.read("parties").filter("party_id = 'DE_Alpha_Party'").count() == 1
    late = store.read("politicians").filter("politician_id = 'KlugB'").withColumns({"name": F.lit("B. Klug"), "country_code": F.lit("FR"), "n": F.lit(1)})
    store.upsert_politicians(late, ["n"])
    row = store.read("politicians").filter("politician_id = 'KlugB'").first()
    assert (row["name"], row.country_code) == ("B. Klug", "DE") and store.read("politicians").count() == 3


def test_extractions_into_the_store(spark, folder, tmp_path):
    store = graph.GraphStore(spark, str(tmp_path / "g"))
    store.upsert_documents(TranscriptSource("de", 5).load(spark, folder, trace=True))
    entity = "array<struct<text:string,label:string,start:int,end:int,score:double>>"
    results = spark.createDataFrame(
        [
            ("u1", [("New York", "LOCATION", 0, 8, 0.9), ("new york", "LOCATION", 9, 17, 0.8)], [("T", ["k"])], [("a", "knows well", "b", None, None)], 0.25, {"ttr": 0.5}),
            ("nowhere", [], [("U", [])], [], 0.1, {}),
        ],
        f"doc_id string, named_entities {entity}, topics array<struct<label:string,keywords:array<string>>>,"
        " triples array<struct<subject:string,relation:string,obj:string,subject_type:string,obj_type:string>>,"
        " sentiment_score double, complexity_metrics map<string,double>",
    )
    for _ in range(2):
        store.upsert_extractions(results)
    speech = store.read("speeches").filter("speech_id = 'u1'").first()
    assert (speech.sentiment_score, speech.ttr, speech.gunning_fog) == (0.25, 0.5, None)
    assert store.read("entities").collect()[0].text == "New York" and store.read("entities").count() == 1
    assert store.read("references_entity").count() == 2
    assert [r.label for r in store.read("topics").collect()] == ["T"]
    assert [tuple(r) for r in store.read("semantic_relation").collect()] == [("a", "b", "KNOWS_WELL", "u1")]
    assert sorted(r.text for r in store.read("concepts").collect()) == ["a", "b"]


def test_small_changes_write_little_and_show_at_once(spark, folder, tmp_path):
    path = str(tmp_path / "g")
    store = graph.GraphStore(spark, path)
    documents = TranscriptSource("de", 5).load(spark, folder, trace=True)
    store.upsert_documents(documents)
    before = set(os.listdir(f"{path}/speeches"))
    number, manifest = store._manifest()
    store.upsert_documents(documents)
    assert store._manifest()[0] == number + 1 and store._manifest()[1] == manifest  # nothing new: no part joins
    result = "doc_id string, named_entities array<struct<text:string,label:string,start:int,end:int,score:double>>, topics array<struct<label:string,keywords:array<string>>>, triples array<struct<subject:string,relation:string,obj:string,subject_type:string,obj_type:string>>, sentiment_score double, complexity_metrics map<string,double>"
    one = spark.createDataFrame([("u1", [], [], [], 0.5, {"ttr": 0.5}), ("u1", [], [], [], 0.25, {"ttr": 0.5})], result)
    store.upsert_extractions(one)
    assert store._manifest()[1]["speeches"] == manifest["speeches"]  # speeches are not written again
    got = {r.speech_id: r for r in store.read("speeches").collect()}
    assert len(got) == 3 and got["u1"].sentiment_score == 0.25 and got["u2"].sentiment_score is None
    store.upsert_extractions(one.withColumn("sentiment_score", F.lit(None).cast("double")))
    assert store.read("speeches").filter("speech_id = 'u1'").first().sentiment_score is None
    vectors_of = spark.createDataFrame([("u2", [1.0], "a", "P", "DE", 2020, "de", 1), ("u2", [2.0], "a", "P", "DE", 2020, "de", 2)], "doc_id string, vector array<float>, model_name string, party string, country_code string, year int, language string, n int")
    store.upsert_embeddings(vectors_of, ["n"])
    speech = store.read("speeches").filter("speech_id = 'u2'").first()
    assert speech.embedding == [2.0] == store.read("embeddings").first().vector
    assert set(os.listdir(f"{path}/speeches")) >= before
    # a reader of an earlier manifest sees all tables as they were
    assert store._manifest(number) == (number, manifest)
    with pytest.raises(ValueError, match="more than one row"):
        store.write({"parties": spark.createDataFrame([("x",), ("x",)], "party_id string").select("party_id", *(F.lit(None).cast("string").alias(c) for c in ("name", "country_code", "abbreviation", "political_family")))})
    with pytest.raises(graph.ConcurrentWrite):
        store._commit(number, {})
    state = sorted(map(str, store.read("speeches").collect()))
    store.compact("embeddings")
    store.compact("speech_updates")
    assert sorted(map(str, store.read("speeches").collect())) == state and len(store._manifest()[1]["speech_updates"]) == 1
    assert [r.raw_text for r in store.texts(spark.createDataFrame([("u2",)], "speech_id string")).collect()] == ["No segments but enough words in it."]


def test_backends_are_made_once_a_worker_and_prefixes_follow_the_model(spark):
    made = extraction.loaded(extraction.HashingEmbedder)
    assert made is extraction.loaded(extraction.HashingEmbedder) and made.embedding_dim == 256
    assert extraction.loaded(made) is made and made.embed_single("a b") == made.embed(["a b"])[0]
    assert extraction.passage_prefix("org/multilingual-e5-large") == "passage: " and extraction.passage_prefix("hashing") == ""


class Counting:
    """Backends that note each text they are asked about in a file."""

    extractor_name = "counting"

    def __init__(self, path):
        self.path = path

    def note(self, kind, text):
        with open(self.path, "a") as f:
            f.write(f"{kind} {text[:8]}\n")

    def extract_batch(self, texts):
        for t in texts:
            self.note("entities", t)
        return [[{"text": t[:4], "label": "event", "start": 0, "end": 4, "score": 0.9}] for t in texts]

    def reply(self, text, correction=None):
        self.note("reply", text)
        return '{"topics": [{"label": "%s"}], "sentiment_score": 0.5}' % text[:4]


def test_a_text_is_asked_about_once(spark, tmp_path, monkeypatch):
    """Over eight tables, over copies, and over runs; another version is asked again."""
    path, notes = str(tmp_path / "results"), tmp_path / "notes"
    store = graph.GraphStore(spark, str(tmp_path / "g"))
    ids = [("u1", "long one " * 60), ("u2", "long one " * 60), ("u3", "long two " * 60), ("u4", "short"), ("u5", None), ("u6", "")]
    documents = spark.createDataFrame(ids, "doc_id string, text string").repartition(3)
    speeches = documents.select(F.col("doc_id").alias("speech_id"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.SPEECHES.fields[1:]))
    store.write({"speeches": speeches})
    backend = Counting(str(notes))
    store.upsert_extractions(results.extract_once(documents, path, backend, backend))
    want = sorted(["entities long one", "entities long two", "entities short", "entities ", "reply long one", "reply long two"])
    assert sorted(notes.read_text().splitlines()) == want
    assert {r.speech_id: r.sentiment_score for r in store.read("speeches").collect()} == {"u1": 0.5, "u2": 0.5, "u3": 0.5, "u4": None, "u5": None, "u6": None}
    assert store.read("mentions_topic").count() == 3 and store.read("topics").count() == 1 and store.read("references_entity").count() == 6
    more = documents.unionByName(spark.createDataFrame([("u7", "new " * 60), ("u8", "short")], documents.schema))
    again = results.extract_once(more, path, backend, backend)
    assert sorted(notes.read_text().splitlines()) == sorted([*want, "entities new new ", "reply new new "])
    assert {r.doc_id: len(r.topics) for r in again.collect()} == {"u1": 1, "u2": 1, "u3": 1, "u4": 0, "u5": 0, "u6": 0, "u7": 1, "u8": 0}
    for changed in ({"version": "2"}, {"least_words": 1}, {"llm": False}):
        before = len(notes.read_text().splitlines())
        assert results.extract_once(documents, path, backend, backend, **changed).count() == 6
        assert len(notes.read_text().splitlines()) >= before + 4
    # Eight tables of results that aren't kept by content: one evaluation still, and its folder goes.
    monkeypatch.setattr(graph, "work_dir", lambda *a: str(tmp_path / "once"))
    notes.write_text("")
    store.upsert_extractions(extraction.extract(documents, backend, backend))
    assert len(notes.read_text().splitlines()) == 9
    assert not (tmp_path / "once").exists()


def test_a_model_for_each_factory(spark):
    rows = spark.createDataFrame([("a", "some words", "P", "DE", "de", "2020-01-01")], "doc_id string, text string, party string, country_code string, language string, date string").withColumn("date", F.to_date("date"))
    small, large = (lambda: extraction.HashingEmbedder(8)), (lambda: extraction.HashingEmbedder(64))
    sizes = [len(extraction.embed(rows, f, model_name="m").first().vector) for f in (small, large, functools.partial(extraction.HashingEmbedder, 16), small, extraction.HashingEmbedder(4))]
    assert sizes == [8, 64, 16, 8, 4]
    assert [len(extraction.loaded(lambda n=n: extraction.HashingEmbedder(n)).embed_single("a")) for n in range(1, 9)] == list(range(1, 9))
    assert len(extraction._loaded) <= extraction.MOST_LOADED
    with pytest.raises(ValueError, match="model_name"):
        extraction.embed(rows, small)


def test_keys_of_other_parts_are_checked(spark, tmp_path):
    store = graph.GraphStore(spark, str(tmp_path / "g"))
    one = spark.createDataFrame([("a",)], "text string")
    store.write({"concepts": one}, add=True)
    store.write({"concepts": spark.createDataFrame([("b",)], "text string")}, add=True)
    with pytest.raises(ValueError, match="more than one row"):
        store.write({"concepts": one}, add=True)
    assert store.read("concepts").count() == 2


def test_vectors_are_stored_by_country_and_year(spark, tmp_path):
    store = graph.GraphStore(spark, str(tmp_path / "g"))
    schema = "doc_id string, vector array<float>, model_name string, party string, country_code string, year int, language string"
    rows = [(f"{c}{y}{i}", [float(i), 1.0], "m", "P", c, y, "x") for c in ("DE", "FR") for y in (2020, 2021) for i in range(3)] + [("n", [1.0, 2.0], "m", "P", None, None, "x")]
    store.upsert_embeddings(spark.createDataFrame(rows, schema))
    found = store.vectors("DE", 2021)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "country_code" in filters and "year" in filters
    assert sorted(r.doc_id for r in found.collect()) == ["DE20210", "DE20211", "DE20212"]
    # A later vector replaces the one before; a document that moves is where it was last, and nowhere else.
    store.upsert_embeddings(spark.createDataFrame([("DE20210", [9.0, 9.0], "m", "P", "DE", 2021, "x"), ("DE20211", [8.0, 8.0], "m", "P", "FR", 2020, "x"), ("n", [7.0, 7.0], "m", "P", "DE", 2021, "x")], schema))
    assert {r.doc_id: r.vector[0] for r in store.vectors("DE", 2021).collect()} == {"DE20210": 9.0, "DE20212": 2.0, "n": 7.0}
    assert {r.doc_id for r in store.vectors("FR", 2020).collect()} == {"FR20200", "FR20201", "FR20202", "DE20211"}
    assert store.read("embeddings").count() == 13
    store.upsert_embeddings(spark.createDataFrame([("DE20211", [6.0, 6.0], "m", "P", "DE", 2021, "x")], schema))  # and back
    assert store.vectors("FR", 2020).count() == 3 and store.vectors("DE").count() == 7
    state = sorted(map(str, store.read("embeddings").collect()))
    store.compact("embeddings")
    assert sorted(map(str, store.read("embeddings").collect())) == state and store.vectors("DE", 2021).count() == 4
    with pytest.raises(ValueError, match="dimensions"):
        store.upsert_embeddings(spark.createDataFrame([("z", [1.0], "m", "P", "DE", 2021, "x")], schema))
    store.recreate("embeddings")
    assert store.read("embeddings").count() == 0 and store.vectors("DE").count() == 0
    store.upsert_embeddings(spark.createDataFrame([("z", [1.0], "m", "P", "DE", 2021, "x")], schema))
    assert store.vectors("DE", 2021).count() == 1


def test_extraction_gate_retry_and_failures(spark):
    class Flaky:
        extractor_name = "flaky"

        def reply(self, text, correction=None):
            if "boom" in text:
                raise RuntimeError
            return '{"sentiment_score": 0.5}' if correction else '{"sentiment_score": 7}'

    class Broken:
        extractor_name = "broken"

        def extract_batch(self, texts):
            if len(texts) > 1 or "bad" in texts[0]:
                raise RuntimeError
            return [[{"text": "E", "label": "person", "start": 0, "end": 1, "score": 0.77777}, {"text": "F", "label": "x", "start": 0, "end": 1, "score": 0.1}]]

    long = "word " * 60
    rows = [("a", long), ("b", "short"), ("c", long + "boom"), ("d", long + "bad"), ("e", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    got = {r.doc_id: r for r in extraction.extract(df, Broken(), Flaky()).collect()}
    assert {k: r.sentiment_score for k, r in got.items()} == {"a": 0.5, "b": None, "c": None, "d": 0.5, "e": None}
    assert [(e.label, e.score) for e in got["a"].named_entities] == [("PERSON", 0.7778)] and got["d"].named_entities == []
    assert got["e"].complexity_metrics == {}
    assert all(r.sentiment_score is None for r in extraction.extract(df, Broken(), Flaky(), llm=False).collect())


def test_extraction_reads_whole_texts(spark):
    long = "an even run of small words " * 450  # more than 10,000 characters
    tail = "says New York in failure."
    df = spark.createDataFrame([("a", long + tail), ("b", long), ("c", "x" * 10_000 + " word" * 60)], "doc_id string, text string")
    got = {r.doc_id: r for r in extraction.extract(df).collect()}
    assert [(e.text, e.start) for e in got["a"].named_entities] == [("New York", len(long) + 5)]
    assert got["a"].complexity_metrics["lexicon_count"] == 450 * 6 + 5
    assert (got["a"].sentiment_score, got["b"].sentiment_score, got["c"].sentiment_score) == (-1.0, 0.0, 0.0)
    rows = df.selectExpr("*", "'P' AS party", "'DE' AS country_code", "'de' AS language", "DATE '2020-01-01' AS date")
    vectors_of = lambda **cap: {r.doc_id: r.vector for r in extraction.embed(rows, **cap).collect()}
    whole, cut = vectors_of(), vectors_of(cap=10_000)
    assert whole["a"] != whole["b"] and cut["a"] == cut["b"]
    assert extraction.extract(df, cap=10_000).filter("doc_id = 'a'").first().sentiment_score == 0.0


def test_centroids_need_five_and_velocity_jumps_gaps(spark):
    rows = [(f"{y}-{i}", [1.0, float(y - 2018)], "X", y, "DE") for y in (2018, 2020) for i in range(5)]
    rows += [(f"n{i}", [1.0, 0.0], "Y", 2018, "DE") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id string, vector array<float>, party string, year int, country_code string")
    means = vectors.centroids(df)
    assert {(r.year, r.party) for r in means.collect()} == {(2018, "X"), (2020, "X")}
    assert [(r.year_from, r.year_to) for r in vectors.velocity(means, "X").collect()] == [(2018, 2020)]
    assert vectors.distance_matrix(means, 2018).first()["X"] == 0.0
    assert [r.doc_id for r in vectors.search(df, [1.0, 0.0], 2, {"party": "Y"}).collect()] == ["n0", "n1"]


@pytest.mark.parametrize("t, p, want", [("aabb", "aabb", 1.0), ("aabb", "abab", -0.5), ("aaaa", "aaaa", 1.0)])
def test_rand_index(spark, t, p, want):
    df = spark.createDataFrame(list(zip(t, p, strict=True)), "t string, p string")
    assert evaluation.adjusted_rand_index(df, "t", "p").first().ari == want


def test_tournament(spark):
    good = [(str(i), [float(i % 2), 1.0 - i % 2], "XY"[i % 2], 2020, "DE") for i in range(20)]
    bad = [(str(i), [float(i // 10), 1.0 - i // 10], "XY"[i % 2], 2020, "DE") for i in range(20)]
    schema = "doc_id string, vector array<float>, party string, year int, country_code string"
    frames = {"bad": spark.createDataFrame(bad, schema), "none": spark.createDataFrame([], schema), "good": spark.createDataFrame(good, schema)}
    best, results = evaluation.tournament(frames)
    assert best == "good" and [r["model_name"] for r in results] == ["bad", "good"]
    with pytest.raises(RuntimeError):
        evaluation.tournament({"none": frames["none"]})


def test_evaluation_is_of_all_vectors(spark):
    party = F.when(F.col("id") == 0, "Rare").otherwise(F.concat(F.lit("P"), F.col("id") % 2))
    vector = F.array(F.col("id") % 2 + 0.001 * (F.col("id") % 7), 1.0 - F.col("id") % 2).cast("array<float>")
    df = spark.range(5200).select(F.col("id").cast("string").alias("doc_id"), vector.alias("vector"), party.alias("party"))
    found = evaluation.evaluate(df, plot=True)
    assert (found["n_samples"], found["n_parties"]) == (5200, 3)
    assert found["points"].count() == 5200 and found["points"].filter("party = 'Rare'").count() == 1
    assert evaluation.evaluate(df, sample=100)["n_samples"] == 100


def test_command_line(spark, folder, tmp_path):
    def run(*argv):
        args = cli.parser().parse_args([*argv, "-c", "de", "--graph-dir", str(tmp_path / "g")])
        assert isinstance(args, argparse.Namespace)
        return args.run(spark, args)

    assert run("ingest", "--data-dir", folder, "--min-tokens", "5", "--dry-run")["documents"] == 3
    assert run("ingest", "--data-dir", folder, "--min-tokens", "5")["errors"] == 1
    # Incremental runs take new files only, and change nothing where all is known.
    more = tmp_path / "more"
    more.mkdir()
    (more / "first.xml").write_text(TEI)
    assert run("ingest", "--data-dir", str(more), "--min-tokens", "5", "--incremental")["documents"] == 3
    assert run("ingest", "--data-dir", str(more), "--min-tokens", "5", "--incremental") == {"documents": 0, "errors": 0, "rate": 0.0}
    (more / "second.xml").write_text("<TEI")
    (more / "third-root.xml").write_text(TEI)
    assert run("ingest", "--data-dir", str(more), "--min-tokens", "5", "--incremental")["errors"] == 1
    assert graph.GraphStore(spark, str(tmp_path / "g")).read("speeches").count() == 3
    assert [os.path.basename(r.path) for r in TranscriptSource("de").paths(spark, str(more)).collect()] == ["first.xml", "second.xml"]
    assert run("extract", "--batch-size", "2", "--max-batches", "1")["documents"] == 2
    last = run("extract", "--batch-size", "2")
    assert (last["documents"], last["batches"], last["errors"]) == (1, 1, 0)
    assert run("extract")["documents"] == 0
    run("analyze", "--step", "embeddings")
    out = str(tmp_path / "out")
    found = run("analyze", "--step", "evaluate", "--plot", "--output-dir", out)["evaluation"]
    assert found["n_samples"] == 3 and found["n_parties"] == 3 and "points" not in found
    page = "\n".join(r.value for r in spark.read.text(f"{out}/vectors_DE").collect())
    assert page.startswith("<!DOCTYPE html>") and page.endswith("</html>") and page.count("<circle") == 3 and "Alpha Party" in page
    best = run("analyze", "--step", "evaluate", "--compare-models")
    assert best["best"] == "hashing" and len(best["results"]) == 1
    report = run("analyze", "--step", "longitudinal", "--party-a", "Alpha Party", "--party-b", "pb", "--output-dir", out)
    assert {r["party"] for r in report["latest"]} == {"Alpha Party", "pb", "Unknown"}
    assert spark.read.option("header", True).csv(f"{out}/complexity_trends_DE").count() == 3


def test_backends_get_parts_of_a_batch(spark):
    """What a task holds of vectors and findings is bounded by rows, however many a batch has."""
    class Counting(extraction.HashingEmbedder):
        def embed(self, texts):
            return [[float(len(texts))] for _ in texts]

    rows = spark.range(3000).coalesce(1).selectExpr("id AS doc_id", "'a b' AS text", "'p' AS party", "'DE' AS country_code", "'de' AS language", "DATE'2020-01-01' AS date")
    sizes = [r.vector[0] for r in extraction.embed(rows, Counting).collect()]
    assert len(sizes) == 3000 and max(sizes) <= extraction.SLICE


def test_replies_are_parsed_once_and_by_all_cores(spark, sf):
    found = flows._results(spark, sf)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism  # part is one small file
    said = [None, "none", '{"sentiment_score": 2}', 'x {"topics": [{"label": "a"}, {"label": ""}], "triples": [{"subject": "s", "obj": "o"}]} y']
    raw = spark.createDataFrame(list(enumerate(said)), "n int, raw string")
    got = [r.r for r in raw.select("n", extraction.parsed_reply(F.col("raw")).alias("r")).orderBy("n").collect()]
    assert got[:3] == [None] * 3
    assert (got[3].topics, got[3].triples, got[3].sentiment_score) == ([("a", [])], [("s", "RELATED_TO", "o", None, None)], 0.0)
