"""The catalogue on the star-schema tables: each query with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.complexity import with_complexity
from ..functions.scalar import rounded
from ..operators import evaluation, layout, vector_index, vectors
from ..storage import work_dir
from . import catalogue as C
from . import views as V
from .registry import query as register

COUNTRY, PARTY_A, PARTY_B = "NATION_0", "BUILDING", "MACHINERY"
START, END = 1995, 2000
TEXT_COUNTRY = "EN"
TREND = ("ttr", "flesch_kincaid_grade", "avg_sentence_length", "gunning_fog")
#: Of the invented English texts none is below grade 6, the default.
GRADE = 8.0
TOPIC, ENTITY, SPEECH = "red widget", "Supplier#000000001", 7


def query(name: str, oracle: str | None = None):
    return register(name, oracle and V.half_up(oracle))


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


SPEECHES, MENTIONS = V.SPEECHES_SQL, V.MENTIONS_SQL.format(by="p_name")
OWN = f"country_code = '{COUNTRY}'"


@query("q1_1_corpus_overview", _with(SPEECHES) + """
SELECT country_code AS country, year, count(*) AS speech_count, count(DISTINCT party) AS parties_active
FROM speeches GROUP BY ALL""")
def q1_1(spark, d):
    return C.corpus_overview(V.speeches(spark, d))


@query("q1_2_party_volume", _with(SPEECHES) + f"""
SELECT party, year, count(*) AS speeches FROM speeches WHERE {OWN} GROUP BY ALL""")
def q1_2(spark, d):
    return C.party_volume(V.speeches(spark, d), COUNTRY)


@query("q1_3_prolific_speakers", _with(SPEECHES) + f"""
SELECT p.name AS politician, p.party, count(*) AS speech_count FROM speeches s JOIN people p USING (politician_id)
WHERE s.{OWN} GROUP BY ALL ORDER BY speech_count DESC, politician, party LIMIT 20""")
def q1_3(spark, d):
    return C.prolific_speakers(V.speeches(spark, d), V.delivered(spark, d), V.politicians(spark, d), COUNTRY)


@query("q1_4_completeness", _with(SPEECHES) + f"""
SELECT count(*) AS total_speeches, count(sentiment_score) AS with_sentiment, count(subcorpus) AS with_complexity,
  count(date) AS with_embedding, round(100.0::DOUBLE * count(sentiment_score) / nullif(count(*), 0), 1) AS pct_extracted
FROM speeches WHERE {OWN}""")
def q1_4(spark, d):
    return C.completeness(V.speeches(spark, d), COUNTRY, "subcorpus", "date")


_TREND = """SELECT year, party, {a} AS avg_sentiment, {s} AS std_sentiment, count(*) AS speech_count FROM speeches
WHERE country_code = '{c}' AND year BETWEEN {lo} AND {hi} AND sentiment_score IS NOT NULL GROUP BY year, party"""
_DEV = "coalesce(stddev_samp(sentiment_score), 0.0::DOUBLE)"


@query("q2_1_sentiment_trend", _with(SPEECHES) + _TREND.format(
    a="round(avg(sentiment_score), 4)", s=f"round({_DEV}, 4)", c=COUNTRY, lo=START, hi=END))
def q2_1(spark, d):
    return C.sentiment_trend(V.speeches(spark, d), COUNTRY, START, END)


@query("q2_2_sentiment_gap", _with(SPEECHES) + f"""
SELECT year, round(a, 4) AS avg_sentiment_party_a, round(b, 4) AS avg_sentiment_party_b, round(abs(a - b), 4) AS sentiment_gap
FROM (SELECT s1.year AS year, avg(s1.sentiment_score) AS a, avg(s2.sentiment_score) AS b FROM speeches s1 JOIN speeches s2
  ON s1.year = s2.year WHERE s1.{OWN} AND s2.{OWN} AND s1.party = '{PARTY_A}' AND s2.party = '{PARTY_B}'
  AND s1.sentiment_score IS NOT NULL AND s2.sentiment_score IS NOT NULL GROUP BY s1.year)""")
def q2_2(spark, d):
    return C.sentiment_gap(V.speeches(spark, d), COUNTRY, PARTY_A, PARTY_B)


@query("q2_3_subcorpus_volume", _with(SPEECHES) + f"""
SELECT coalesce(subcorpus, 'REGULAR') AS subcorpus, year, count(*) AS speeches FROM speeches WHERE {OWN} GROUP BY ALL""")
def q2_3(spark, d):
    return C.subcorpus_volume(V.speeches(spark, d), COUNTRY)


@query("q3_1_top_topics", _with(SPEECHES, MENTIONS) + f"""
SELECT topic, count(*) AS total_mentions, count(DISTINCT party) AS parties_mentioning,
  round(avg(sentiment_score), 3) AS avg_sentiment_when_mentioned
FROM speeches JOIN mentions USING (speech_id) WHERE {OWN} GROUP BY topic ORDER BY total_mentions DESC, topic LIMIT 30""")
def q3_1(spark, d):
    return C.top_topics(V.speeches(spark, d), V.mentions(spark, d), COUNTRY)


@query("q3_2_topic_salience", _with(SPEECHES, MENTIONS) + f"""
SELECT year, party, count(*) AS mention_count, round(avg(sentiment_score), 4) AS avg_sentiment
FROM speeches JOIN mentions USING (speech_id) WHERE {OWN} AND topic = '{TOPIC}' AND year BETWEEN {START} AND {END} GROUP BY year, party""")
def q3_2(spark, d):
    return C.topic_salience(V.speeches(spark, d), V.mentions(spark, d), COUNTRY, TOPIC, START, END)


@query("q3_3_topic_growth", _with(SPEECHES, MENTIONS) + f"""
SELECT topic, count_1995, count_2000, round((count_2000 - count_1995)::DOUBLE / count_1995 * 100, 1) AS pct_change FROM
(SELECT topic, count(*) FILTER (year = 1995) AS count_1995, count(*) FILTER (year = 2000) AS count_2000
  FROM speeches JOIN mentions USING (speech_id) WHERE {OWN} GROUP BY topic)
WHERE count_1995 > 0 ORDER BY pct_change DESC, topic LIMIT 20""")
def q3_3(spark, d):
    return C.topic_growth(V.speeches(spark, d), V.mentions(spark, d), COUNTRY, 1995, 2000)


@query("q3_4_topic_pairs", _with(SPEECHES, MENTIONS) + f"""
SELECT a.topic AS topic_a, b.topic AS topic_b, count(*) AS co_occurrence_count
FROM speeches s JOIN mentions a USING (speech_id) JOIN mentions b USING (speech_id) WHERE {OWN} AND a.topic < b.topic
GROUP BY ALL ORDER BY co_occurrence_count DESC, topic_a, topic_b LIMIT 20""")
def q3_4(spark, d):
    return C.topic_pairs(V.speeches(spark, d), V.mentions(spark, d), COUNTRY)


@query("q3_5_exclusive_topics", _with(SPEECHES, V.MENTIONS_SQL.format(by="p_partkey")) + f"""
SELECT topic, party, round(n::DOUBLE / total * 100, 1) AS share_pct, n AS party_mentions, total AS total_mentions FROM
(SELECT topic, party, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY topic) AS BIGINT) AS total
  FROM speeches JOIN mentions USING (speech_id) WHERE {OWN} AND year >= {START} GROUP BY topic, party)
WHERE n::DOUBLE / total > 0.5""")
def q3_5(spark, d):
    return C.exclusive_topics(V.speeches(spark, d), V.mentions(spark, d, "p_partkey"), COUNTRY, START)


_GRADES = f"""SELECT party, year, avg(flesch_kincaid_grade) AS fk FROM measured
WHERE country_code = '{TEXT_COUNTRY}' AND flesch_kincaid_grade IS NOT NULL GROUP BY party, year"""


@query("q4_1_complexity_trend", _with(V.TEXTS_SQL) + f"""
SELECT year, party, round(avg(ttr), 4) AS avg_ttr, round(avg(flesch_kincaid_grade), 2) AS avg_fk_grade,
  round(avg(avg_sentence_length), 2) AS avg_sentence_length, round(avg(gunning_fog), 2) AS avg_gunning_fog, count(*) AS speech_count
FROM measured WHERE country_code = '{TEXT_COUNTRY}' AND year >= {START} AND ttr IS NOT NULL GROUP BY year, party""")
def q4_1(spark, d):
    return C.complexity_trend(V.measured(spark, d, *TREND), TEXT_COUNTRY, START)


@query("q4_2_grade_series", _with(V.TEXTS_SQL) + f"""
SELECT party, string_agg(year || ':' || printf('%.3f', round(fk, 3)), ' ' ORDER BY year) AS series FROM ({_GRADES}) GROUP BY party""")
def q4_2(spark, d):
    shown = F.transform("series", lambda s: F.concat(s["year"].cast("string"), F.lit(":"), F.format_string("%.3f", rounded(s["fk"], 3))))
    return C.grade_series(V.measured(spark, d, "flesch_kincaid_grade"), TEXT_COUNTRY).select("party", F.array_join(shown, " ").alias("series"))


@query("q4_2_grade_changes", _with(V.TEXTS_SQL) + f"""
SELECT party, year, round(fk, 4) AS fk_grade, round(fk - lag(fk) OVER (PARTITION BY party ORDER BY year), 4) AS fk_change FROM ({_GRADES})""")
def q4_2_changes(spark, d):
    return C.grade_changes(V.measured(spark, d, "flesch_kincaid_grade"), TEXT_COUNTRY)


@query("q4_3_simple_speeches", _with(V.TEXTS_SQL) + f"""
SELECT speech_id, party, year, round(flesch_kincaid_grade, 2) AS fk_grade, round(ttr, 4) AS ttr, CAST(word_count AS INTEGER) AS words
FROM measured WHERE country_code = '{TEXT_COUNTRY}' AND flesch_kincaid_grade < {GRADE} AND word_count > 200 ORDER BY fk_grade, speech_id LIMIT 50""")
def q4_3(spark, d):
    return C.simple_speeches(V.measured(spark, d, "flesch_kincaid_grade", "ttr"), TEXT_COUNTRY, GRADE)


@query("q5_1_top_entities", _with(SPEECHES, V.REFERENCES_SQL) + f"""
SELECT text AS entity, label AS entity_type, count(*) AS mention_count, count(DISTINCT party) AS parties_mentioning
FROM speeches JOIN refs USING (speech_id) WHERE {OWN} AND year >= {START} GROUP BY ALL
ORDER BY mention_count DESC, entity, entity_type LIMIT 30""")
def q5_1(spark, d):
    return C.top_entities(V.speeches(spark, d), V.references(spark, d), COUNTRY, START)


@query("q5_2_entity_sentiment", _with(SPEECHES, V.REFERENCES_SQL) + f"""
SELECT party, year, count(*) AS mentions, round(avg(sentiment_score), 3) AS avg_sentiment FROM speeches JOIN refs USING (speech_id)
WHERE {OWN} AND text = '{ENTITY}' AND sentiment_score IS NOT NULL GROUP BY party, year""")
def q5_2(spark, d):
    return C.entity_sentiment(V.speeches(spark, d), V.references(spark, d), COUNTRY, ENTITY)


_STATED = f"""mine AS (SELECT s.speech_id FROM speeches s JOIN people p USING (politician_id)
  WHERE s.{OWN} AND p.party = '{PARTY_A}')"""


@query("q5_3_party_relations", _with(SPEECHES, V.RELATIONS_SQL, _STATED) + """
SELECT r.relation AS relation_type, count(*) AS frequency FROM (SELECT DISTINCT speech_id, subject FROM relations) c
JOIN relations r USING (subject) WHERE r.speech_id IN (SELECT speech_id FROM mine)
GROUP BY ALL ORDER BY frequency DESC, relation_type LIMIT 20""")
def q5_3(spark, d):
    return C.party_relations(V.speeches(spark, d), V.delivered(spark, d), V.politicians(spark, d), V.relations(spark, d), PARTY_A, COUNTRY)


@query("q5_3_party_relations_tied", _with(SPEECHES, V.RELATIONS_SQL, _STATED) + """
SELECT relation AS relation_type, count(*) AS frequency FROM relations WHERE speech_id IN (SELECT speech_id FROM mine)
GROUP BY ALL ORDER BY frequency DESC, relation_type LIMIT 20""")
def q5_3_tied(spark, d):
    parts = V.speeches(spark, d), V.delivered(spark, d), V.politicians(spark, d), V.relations(spark, d)
    return C.party_relations(*parts, PARTY_A, COUNTRY, tied=True)


@query("q6_1_bridges", _with(SPEECHES, MENTIONS) + f""", spoke AS (SELECT DISTINCT s.politician_id, topic FROM speeches s JOIN mentions USING (speech_id))
SELECT a.name AS politician_a, a.party AS party_a, b.name AS politician_b, b.party AS party_b,
  string_agg(DISTINCT x.topic, '|' ORDER BY x.topic) AS shared_topics, count(DISTINCT x.topic) AS topic_overlap
FROM spoke x JOIN spoke y USING (topic) JOIN people a ON a.politician_id = x.politician_id JOIN people b ON b.politician_id = y.politician_id
WHERE a.{OWN} AND a.party <> b.party AND x.politician_id < y.politician_id
GROUP BY a.name, a.party, b.name, b.party ORDER BY topic_overlap DESC, politician_a, politician_b, party_a, party_b LIMIT 20""")
def q6_1(spark, d):
    found = C.bridges(V.delivered(spark, d), V.politicians(spark, d), V.mentions(spark, d), COUNTRY)
    return found.withColumn("shared_topics", F.array_join("shared_topics", "|"))


@query("q6_2_year_snapshot", _with(SPEECHES, MENTIONS) + f"""
SELECT p.name AS speaker, p.party, speech_id, topic, sentiment_score AS sentiment
FROM speeches s JOIN mentions USING (speech_id) JOIN people p USING (politician_id) WHERE s.{OWN} AND year = 1997""")
def q6_2(spark, d):
    return C.year_snapshot(V.speeches(spark, d), V.delivered(spark, d), V.politicians(spark, d), V.mentions(spark, d), COUNTRY, 1997)


_SCORES = "(1 + " + V.COSINE_SQL.format(a="e.vector", b="r.vector") + ") / 2"


@query("q7_1_similar_speeches", _with(V.EMBEDDED_SQL) + f"""
SELECT doc_id AS speech_id, party, year, round(score, 4) AS cosine_similarity FROM
(SELECT e.*, {_SCORES} AS score FROM embedded e, (SELECT vector FROM embedded WHERE doc_id = {SPEECH}) r
  ORDER BY score DESC, doc_id LIMIT 10) WHERE doc_id <> {SPEECH}""")
def q7_1(spark, d):
    return C.similar_speeches(V.embedded(spark, d), SPEECH)


@query("q7_2_topic_cluster", _with(V.EMBEDDED_SQL, MENTIONS) + f"""
SELECT party, year, count(*) AS speeches_in_cluster, round(avg(score), 6) AS avg_similarity FROM
(SELECT e.*, {_SCORES} AS score FROM embedded e, (SELECT vector FROM embedded WHERE doc_id IN
    (SELECT speech_id FROM mentions WHERE topic = '{TOPIC}') ORDER BY doc_id LIMIT 1) r ORDER BY score DESC, doc_id LIMIT 50)
GROUP BY party, year""")
def q7_2(spark, d):
    return C.topic_cluster(V.embedded(spark, d), V.mentions(spark, d), TOPIC)


@query("p1_topic_salience_over_time", _with(SPEECHES, MENTIONS) + f"""
SELECT year, party, count(*) AS mention_count, round(avg(sentiment_score), 9) AS avg_sentiment
FROM speeches JOIN mentions USING (speech_id) WHERE {OWN} AND topic = '{TOPIC}' AND year BETWEEN {START} AND {END} GROUP BY year, party""")
def p1(spark, d):
    found = C.topic_salience(V.speeches(spark, d), V.mentions(spark, d), COUNTRY, TOPIC, START, END, None)
    return found.withColumn("avg_sentiment", rounded("avg_sentiment", 9))


@query("p2_complexity_trends", _with(V.TEXTS_SQL) + f"""
SELECT year, party, round(avg(ttr), 4) AS avg_ttr, round(avg(flesch_kincaid_grade), 2) AS avg_fk_grade,
  round(avg(avg_sentence_length), 2) AS avg_sentence_length, round(avg(gunning_fog), 2) AS avg_gunning_fog, count(*) AS speech_count
FROM measured JOIN orders ON o_orderkey = speech_id JOIN customer ON c_custkey = o_custkey
WHERE country_code = '{TEXT_COUNTRY}' AND year BETWEEN {START} AND {END} AND ttr IS NOT NULL GROUP BY year, party""")
def p2(spark, d):
    by = V.delivered(spark, d).join(V.politicians(spark, d).select("politician_id"), "politician_id").select("speech_id")
    return C.complexity_trend(V.measured(spark, d, *TREND).join(by, "speech_id"), TEXT_COUNTRY, START, END)


@query("p3_sentiment_trends", _with(SPEECHES) + _TREND.format(
    a="round(avg(sentiment_score), 9)", s=f"round({_DEV}, 9)", c=COUNTRY, lo=START, hi=END))
def p3(spark, d):
    found = C.sentiment_trend(V.speeches(spark, d), COUNTRY, START, END, None)
    return found.withColumns({c: rounded(c, 9) for c in ("avg_sentiment", "std_sentiment")})


@query("p4_speeches_for_analysis", _with(SPEECHES) + f"""
SELECT speech_id, politician_id, s.date, year, s.party, s.country_code, subcorpus, sentiment_score, p.name AS speaker_name
FROM speeches s JOIN people p USING (politician_id) WHERE s.{OWN} AND year BETWEEN {START} AND {END}""")
def p4(spark, d):
    return C.speeches_for_analysis(V.speeches(spark, d), V.delivered(spark, d), V.politicians(spark, d), COUNTRY, START, END)


@query("p5_unprocessed_speeches", _with(SPEECHES) + f"""
SELECT speech_id, year, party FROM speeches WHERE {OWN} AND sentiment_score IS NULL ORDER BY speech_id LIMIT 50""")
def p5(spark, d):
    rows = V.speeches(spark, d)
    return C.unprocessed(rows, rows.filter("sentiment_score IS NOT NULL"), COUNTRY, 50).select("speech_id", "year", "party")


@query("p6_centroids", _with(V.EMBEDDED_SQL) + """
SELECT year, party, n AS n_vectors, round(centroid[1], 6) AS first, round(sqrt(list_dot_product(centroid, centroid)), 6) AS norm
FROM centroids JOIN cells USING (year, party)""")
def p6_centroids(spark, d):
    c = vectors.centroids(V.embedded(spark, d))
    norm = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x))
    return c.select("year", "party", "n_vectors", rounded(F.col("centroid")[0], 6).alias("first"), rounded(norm, 6).alias("norm"))


_AB = V.COSINE_SQL.format(a="a.centroid", b="b.centroid")


@query("p6_drift", _with(V.EMBEDDED_SQL) + f"""
SELECT year, a.party AS party_a, b.party AS party_b, round(1 - {_AB}, 6) AS cosine_distance
FROM centroids a JOIN centroids b USING (year) WHERE a.party = 'P1' AND b.party = 'P2'""")
def p6_drift(spark, d):
    return vectors.drift(vectors.centroids(V.embedded(spark, d)), "P1", "P2")


@query("p6_velocity", _with(V.EMBEDDED_SQL) + f"""
SELECT b.year, b.party, round(1 - {_AB}, 6) AS velocity, a.year AS year_from, b.year AS year_to FROM centroids a JOIN
(SELECT *, lag(year) OVER (PARTITION BY party ORDER BY year) AS y FROM centroids) b ON a.party = b.party AND a.year = b.y""")
def p6_velocity(spark, d):
    return vectors.velocity(vectors.centroids(V.embedded(spark, d)))


@query("p6_pairwise", _with(V.EMBEDDED_SQL) + f"""
SELECT a.party, b.party AS other, CASE WHEN a.party = b.party THEN 0.0 ELSE round(1 - {_AB}, 6) END AS distance
FROM centroids a JOIN centroids b USING (year) WHERE year = 1997""")
def p6_pairwise(spark, d):
    return vectors.pairwise(vectors.centroids(V.embedded(spark, d)), 1997)


_QUERY = [round(((i * 37) % 64) / 64 - 0.5, 6) for i in range(64)]


@query("p7_vector_search", _with(V.EMBEDDED_SQL) + f"""
SELECT e.doc_id, e.party, e.year, round({V.COSINE_SQL.format(a='e.vector', b='r.vector')}, 6) AS score
FROM embedded e, (SELECT {_QUERY}::DOUBLE[] AS vector) r WHERE e.year = 1997 ORDER BY score DESC, doc_id LIMIT 10""")
def p7(spark, d):
    found = vectors.search(V.embedded(spark, d), _QUERY, 10, {"country_code": "DE", "year": 1997})
    return found.select("doc_id", "party", "year", rounded("score", 6).alias("score"))


def _index(spark, d):
    return vector_index.build(V.embedded(spark, d), work_dir(spark, "vectors"))


@query("p7_vector_search_indexed", _with(V.EMBEDDED_SQL) + f"""
SELECT e.doc_id, e.party, e.year, round({V.COSINE_SQL.format(a='e.vector', b='r.vector')}, 6) AS score
FROM embedded e, (SELECT {_QUERY}::DOUBLE[] AS vector) r WHERE e.year = 1997 ORDER BY score DESC, doc_id LIMIT 10""")
def p7_indexed(spark, d):
    """The filtered search through an index of all vectors: cells that cannot hold one of the ten best aren't read."""
    found, _ = _index(spark, d).search(_QUERY, 10, {"country_code": "DE", "year": 1997})
    return found.select("doc_id", "party", "year", rounded("score", 6).alias("score"))


@query("q7_1_similar_speeches_join", _with(V.EMBEDDED_SQL) + f"""
, pairs AS (SELECT q.doc_id AS query_id, e.doc_id, round({V.COSINE_SQL.format(a='q.vector', b='e.vector')}, 6) AS score
  FROM embedded q JOIN embedded e ON q.doc_id % 50 = 0 AND q.doc_id <> e.doc_id),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, doc_id AS speech_id, score AS cosine_similarity, rank FROM best WHERE rank <= 10""")
def q7_1_join(spark, d):
    """The ten speeches most similar to each one whose id is divisible by 50, among all."""
    asked = V.embedded(spark, d).filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    found = _index(spark, d).join(asked, 10)
    return found.select("query_id", F.col("doc_id").alias("speech_id"), F.col("score").alias("cosine_similarity"), "rank")


@query("p8_latest_complexity", _with(V.TEXTS_SQL) + f"""
SELECT party, max_by(avg_ttr, year) AS avg_ttr, max_by(avg_fk, year) AS avg_fk_grade FROM
(SELECT party, year, round(avg(ttr), 4) AS avg_ttr, round(avg(flesch_kincaid_grade), 2) AS avg_fk FROM measured
 WHERE country_code = '{TEXT_COUNTRY}' AND year >= {START} AND ttr IS NOT NULL GROUP BY party, year) GROUP BY party""")
def p8(spark, d):
    return C.latest_per_party(C.complexity_trend(V.measured(spark, d, *TREND), TEXT_COUNTRY, START), ["avg_ttr", "avg_fk_grade"])


@query("text_complexity", _with(V.TEXTS_SQL) + """
SELECT speech_id, CAST(word_count AS INTEGER) AS word_count, ttr, cttr, avg_sentence_length, avg_word_length, flesch_reading_ease,
  flesch_kincaid_grade, gunning_fog, lexicon_count, sentence_count FROM measured""")
def text_complexity(spark, d):
    from ..functions.complexity import METRICS

    return V.measured(spark, d).select("speech_id", "word_count", *METRICS)


_BY_LANGUAGE = V.TEXTS_SQL.replace("SELECT *, list_transform(lex, lambda w:\n  greatest(len(regexp_extract_all(lower(w), '[aeiouyà-æè-ïò-öø-ýÿœ]+')), 1)) AS syls,", r"""SELECT *, list_transform(lex, lambda w: greatest(1, len(CASE country_code
    WHEN 'EN' THEN regexp_extract_all(regexp_replace(lower(w), '([aeiouy].*[^aeiouyl])e$', '\1'), '[aeiouyà-æè-ïò-öø-ýÿœ]+')
    WHEN 'FR' THEN regexp_extract_all(regexp_replace(lower(w), '(?:([aeiouyà-ÿœ].*[qg])u|([aeiouyà-ÿœ].*[^aeiouyà-ÿœ]))es?$', '\1\2'), '[aeiouyà-æè-ïò-öø-ýÿœ]+')
    WHEN 'DE' THEN regexp_extract_all(lower(w), 'ie|ei|ai|au|eu|äu|ey|ay|oi|aa|ee|oo|[aeiouyäöüéèà]')
    ELSE regexp_extract_all(lower(w), '[iuüy]*[aeoáéíóúàèìòùâêôãõ][iuy]*|[iuüy]+') END))) AS syls,""").replace(
    "206.835::DOUBLE - 1.015::DOUBLE * (len(lex)::DOUBLE / sent) - 84.6::DOUBLE *",
    "(CASE country_code WHEN 'EN' THEN 206.835::DOUBLE WHEN 'FR' THEN 207 WHEN 'DE' THEN 180 ELSE 206.84::DOUBLE END)"
    " - (CASE country_code WHEN 'DE' THEN 1 WHEN 'ES' THEN 1.02::DOUBLE ELSE 1.015::DOUBLE END) * (len(lex)::DOUBLE / sent)"
    " - (CASE country_code WHEN 'EN' THEN 84.6::DOUBLE WHEN 'FR' THEN 73.6::DOUBLE WHEN 'DE' THEN 58.5::DOUBLE ELSE 60 END) *",
)


@query("text_complexity_by_language", _with(_BY_LANGUAGE) + """
SELECT speech_id, flesch_reading_ease, flesch_kincaid_grade, gunning_fog FROM measured""")
def text_complexity_by_language(spark, d):
    """Grades by the rules of each document's own language: English, French, German or Spanish."""
    made = with_complexity(V.texts(spark, d), metrics=("flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog"), language=F.col("country_code"))
    return made.filter("gunning_fog IS NOT NULL").select("speech_id", "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog")



@query("ml_adjusted_rand_index", """
WITH p AS (SELECT label AS t, vec_id % 7 + label // 3 AS c, count(*) AS n FROM embeddings GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM p) AS cells, (SELECT sum(n)::DOUBLE FROM p) AS total,
 (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM (SELECT sum(n)::DOUBLE AS n FROM p GROUP BY t)) AS a,
 (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM (SELECT sum(n)::DOUBLE AS n FROM p GROUP BY c)) AS b)
SELECT round((cells - a * b / (total * (total - 1) / 2)) / ((a + b) / 2 - a * b / (total * (total - 1) / 2)), 4) AS ari FROM s""")
def ml_ari(spark, d):
    rows = V.read(spark, d, "embeddings").select("label", (F.col("vec_id") % 7 + F.floor(F.col("label") / 3)).alias("c"))
    return evaluation.adjusted_rand_index(rows, "label", "c")


@query("ml_cluster_evaluation")
def ml_evaluate(spark, d):
    found = evaluation.evaluate(V.embedded(spark, d), "hashing")
    return spark.createDataFrame([found], "model_name string, ari double, silhouette double, n_samples long, n_parties long")


@query("ml_projection_2d")
def ml_projection(spark, d):
    found = evaluation.evaluate(V.embedded(spark, d), plot=True)["points"]
    return found.select("doc_id", "party", "cluster", rounded("x", 6).alias("x"), rounded("y", 6).alias("y"))


@query("ml_neighbour_graph", _with(V.EMBEDDED_SQL) + """
SELECT count(*) AS n_vectors, count(*) * 15 AS n_edges, true AS recall_enough FROM embedded""")
def ml_neighbour_graph(spark, d):
    """The neighbour graph of all vectors; its recall against the exact neighbours of those whose id is divisible by 50."""
    rows = V.embedded(spark, d)
    edges = layout.neighbour_graph(rows)
    asked = rows.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    exact = vector_index.build(rows, work_dir(spark, "vectors")).join(asked, layout.NEIGHBOURS)
    met = exact.join(edges.select(F.col("u").alias("query_id"), F.col("v").alias("doc_id"), F.lit(1).alias("found")), ["query_id", "doc_id"], "left")
    recall = met.agg((F.count("found") / F.count(F.lit(1)) >= 0.9).alias("recall_enough"))
    counts = edges.agg(F.count_distinct("u").alias("n_vectors"), F.count(F.lit(1)).alias("n_edges"))
    return counts.crossJoin(recall)  # one row each


@query("ml_neighbour_layout")
def ml_neighbour_layout(spark, d):
    return layout.spectral_layout(layout.neighbour_graph(V.embedded(spark, d)))


@query("ml_cluster_separated", _with(V.EMBEDDED_SQL) + """
SELECT 1.0::DOUBLE AS ari, count(*) AS n_samples, count(DISTINCT party) AS n_parties FROM embedded""")
def ml_cluster_separated(spark, d):
    """The evaluation of all vectors, drawn apart by party: clusters have to be the parties then."""
    rows = evaluation.encode_labels(V.embedded(spark, d))
    apart = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == F.col("label_id") % 64, 100.0).otherwise(0.0))
    drawn = rows.withColumn("vector", F.concat(apart, F.transform("vector", lambda x: x.cast("double"))))
    found = evaluation.evaluate(drawn.drop("label_id"), "separated")
    return spark.createDataFrame([(found["ari"], found["n_samples"], found["n_parties"])], "ari double, n_samples long, n_parties long")
