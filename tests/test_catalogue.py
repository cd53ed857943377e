"""Every query with an oracle against DuckDB, and hand-computed cases that the tables do not hold."""

import math

import pytest
from pyspark.sql import Row

from plenaria.plans import catalogue as C
from plenaria.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


def rows(records, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name])
    assert rows(got, df.columns) == rows(want.fetchall(), list(want.columns))


SPEECH = "speech_id string, country_code string, year int, party string, sentiment_score double, subcorpus string"


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame(
        [
            ("a", "DE", 2020, "X", 0.5, None),
            ("b", "DE", 2020, "Y", -0.5, "COVID"),
            ("c", "DE", 2020, "Y", 0.5, None),
            ("d", "DE", 2022, "X", None, None),
            ("e", "FR", 2020, "X", 0.1, None),
        ],
        SPEECH,
    )


def test_single_speech_has_deviation_zero(tiny):
    got = {(r.year, r.party): r for r in C.sentiment_trend(tiny, "DE", 2020, 2022).collect()}
    assert got[2020, "X"].std_sentiment == 0.0
    assert math.isclose(got[2020, "Y"].std_sentiment, 0.7071)
    assert (2022, "X") not in got


def test_gap_and_null_subcorpus(tiny):
    assert [tuple(r) for r in C.sentiment_gap(tiny, "DE", "X", "Y").collect()] == [(2020, 0.5, 0.0, 0.5)]
    assert {(r.subcorpus, r.year): r.speeches for r in C.subcorpus_volume(tiny, "DE").collect()}[("REGULAR", 2020)] == 2


def test_completeness_of_nothing(tiny):
    row = C.completeness(tiny, "XX", "party", "party").first()
    assert row.total_speeches == 0 and row.pct_extracted is None


def test_relations_count_once_per_speech_with_the_subject(spark, tiny):
    people = spark.createDataFrame([("p", "P", "X", "DE")], "politician_id string, name string, party string, country_code string")
    delivered = spark.createDataFrame([("p", "a")], "politician_id string, speech_id string")
    relations = spark.createDataFrame(
        [Row(speech_id="a", subject="s", relation="R", obj="o"), Row(speech_id="b", subject="s", relation="R", obj="o")]
    )
    assert C.party_relations(tiny, delivered, people, relations, "X", "DE").first().frequency == 2
    assert C.party_relations(tiny, delivered, people, relations, "X", "DE", tied=True).first().frequency == 1


def test_namesakes_are_one_speaker(spark, tiny):
    people = spark.createDataFrame(
        [("p", "Same", "X", "DE"), ("q", "Same", "X", "DE")], "politician_id string, name string, party string, country_code string"
    )
    delivered = spark.createDataFrame([("p", "a"), ("q", "b")], "politician_id string, speech_id string")
    assert [tuple(r) for r in C.prolific_speakers(tiny, delivered, people, "DE").collect()] == [("Same", "X", 2)]


def test_latest_skips_nulls_by_column(spark):
    trend = spark.createDataFrame([("X", 2019, 1.0, 2.0), ("X", 2020, None, 3.0), (None, 2020, 9.0, 9.0)], "party string, year int, a double, b double")
    assert [tuple(r) for r in C.latest_per_party(trend, ["a", "b"]).collect()] == [("X", 1.0, 3.0)]


def test_series_and_changes_over_a_gap(spark):
    s = spark.createDataFrame([("DE", 2018, "X", 5.0), ("DE", 2020, "X", 7.0)], "country_code string, year int, party string, flesch_kincaid_grade double")
    assert [(x.year, x.fk) for x in C.grade_series(s, "DE").first().series] == [(2018, 5.0), (2020, 7.0)]
    assert {r.year: r.fk_change for r in C.grade_changes(s, "DE").collect()} == {2018: None, 2020: 2.0}


@pytest.mark.parametrize("namesakes", [False, True])
def test_bridges_with_and_without_namesakes(spark, namesakes):
    people = [("1", "A", "X", "DE"), ("2", "B", "Y", "FR"), ("3", "C", "X", "DE")] + [("4", "B", "Y", "DE")] * namesakes
    politicians = spark.createDataFrame(people, "politician_id string, name string, party string, country_code string")
    delivered = spark.createDataFrame([(p, f"s{p}") for p, *_ in people], "politician_id string, speech_id string")
    said = [("s1", "t"), ("s1", "u"), ("s2", "t"), ("s2", "u"), ("s3", "t")] + [("s4", "u"), ("s4", "t")] * namesakes
    mentions = spark.createDataFrame(said, "speech_id string, topic string")
    got = [tuple(r) for r in C.bridges(delivered, politicians, mentions, "DE").collect()]
    assert got[0] == ("A", "X", "B", "Y", ["t", "u"], 2)
    assert got[1:] == ([("C", "X", "B", "Y", ["t"], 1)] if namesakes else [])


def test_reports_are_in_order(spark):
    """Several keys up, mixed directions with ties, and nulls last."""
    rows = [("b", "DE", 2020, "X", 0.0, None), ("a", "DE", 2019, "Y", 0.0, None), ("c", "DE", 2020, "Y", 0.0, None), ("d", "DE", 2020, "Y", 0.0, None),
            ("e", "DE", 2020, "A", 0.0, None), ("f", "AT", 2021, "X", 0.0, None), ("g", None, 2021, "X", 0.0, None), ("h", "DE", None, "X", 0.0, None)]
    df = spark.createDataFrame(rows, SPEECH).repartition(5)
    assert [(r.country, r.year) for r in C.corpus_overview(df).collect()] == [("AT", 2021), ("DE", 2019), ("DE", 2020), ("DE", None), (None, 2021)]
    assert [(r.year, r.party, r.speeches) for r in C.party_volume(df, "DE").collect()] == [(2019, "Y", 1), (2020, "Y", 2), (2020, "A", 1), (2020, "X", 1), (None, "X", 1)]
    trend = [(r.year, r.party) for r in C.sentiment_trend(df, "DE", 2000, 2030).collect()]
    assert trend == sorted(trend)


def test_metrics_are_evaluated_once(spark, sf):
    """A filter on a metric does not bring its expressions into the scan's filter again."""
    def plan(name):
        return QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()

    most = plan("text_complexity")
    for name in ("q4_1_complexity_trend", "q4_2_grade_series", "q4_2_grade_changes", "p2_complexity_trends", "p8_latest_complexity"):
        for call in ("split(", "regexp_extract_all"):
            assert plan(name).count(call) <= most.count(call), (name, call)
