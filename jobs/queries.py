"""The jobs as queries: each runs twice over the whole tables into a new shared folder and gives the output read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plenaria.plans import views as V
from plenaria.storage import work_dir

from .party_report import party_report
from .speech_ingest import speech_ingest


def job1_party_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"orders": "orders", "customers": "customer", "nations": "nation", "embeddings": "embeddings"}
    paths = {k: f"{sf_dir}/{t}.parquet" for k, t in tables.items()} | {"out": f"{work_dir(spark, 'party_report')}/out"}
    party_report(spark, **paths)
    return party_report(spark, **paths)


def job2_speech_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_dir(spark, "speech_ingest")
    paths = {"documents": f"{sf_dir}/documents.parquet", "orders": f"{sf_dir}/orders.parquet", "out": f"{base}/out", "checkpoint": f"{base}/checkpoint"}
    speech_ingest(spark, **paths)
    return speech_ingest(spark, **paths)


JOB1_SQL = V.half_up(
    f"""
WITH {V.SPEECHES_SQL.strip()},
tone AS (SELECT year, party, count(*) AS n_speeches, round(avg(sentiment_score), 4) AS avg_sentiment,
  round(CASE WHEN count(sentiment_score) = 1 THEN 0.0 ELSE stddev_samp(sentiment_score) END, 4) AS std_sentiment FROM speeches GROUP BY ALL),
changed AS (SELECT *, round(avg_sentiment - lag(avg_sentiment) OVER (PARTITION BY party ORDER BY year), 4) AS sentiment_change FROM tone),
embedded AS (SELECT s.year, s.party, list_transform(embedding, lambda x: x::DOUBLE) AS vector FROM embeddings JOIN speeches s ON s.speech_id = vec_id),
cells AS (SELECT year, party, count(*) AS n FROM embedded GROUP BY ALL HAVING count(*) >= 5),
dims AS (SELECT year, party, i, avg(vector[i]) AS v FROM embedded JOIN cells USING (year, party), range(1, 65) t(i) GROUP BY ALL),
centroids AS (SELECT year, party, any_value(n) AS n, list(v ORDER BY i) AS centroid FROM dims JOIN cells USING (year, party) GROUP BY ALL),
lagged AS (SELECT *, lag(centroid) OVER w AS was, lag(year) OVER w AS year_from FROM centroids WINDOW w AS (PARTITION BY party ORDER BY year)),
moved AS (SELECT year, party, n, year_from, CASE WHEN was IS NOT NULL THEN round(1 - {V.COSINE_SQL.format(a="was", b="centroid")}, 6) END AS velocity FROM lagged),
near AS (SELECT a.year, a.party, min({{'d': round(1 - {V.COSINE_SQL.format(a="a.centroid", b="b.centroid")}, 6), 'o': b.party}}) AS p
  FROM centroids a JOIN centroids b ON a.year = b.year AND a.party <> b.party GROUP BY ALL)
SELECT party, n_speeches, avg_sentiment, std_sentiment, sentiment_change, coalesce(n, 0) AS n_vectors, velocity, year_from,
  p.o AS nearest_party, p.d AS nearest_distance, year
FROM changed LEFT JOIN moved USING (year, party) LEFT JOIN near USING (year, party)"""
)

JOB2_SQL = V.half_up(
    r"""
WITH given AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'text-' || sha256(coalesce(text, ''))) AS speech_id, doc_id, text, lang, source FROM documents),
one AS (SELECT * FROM given QUALIFY row_number() OVER (PARTITION BY speech_id ORDER BY lang NULLS FIRST, source NULLS FIRST, text NULLS FIRST) = 1),
"""
    + V.TEXTS_SQL.strip().replace("FROM documents JOIN orders ON o_orderkey = doc_id", "FROM one LEFT JOIN orders ON o_orderkey = doc_id").replace("SELECT doc_id AS speech_id", "SELECT speech_id")
    + r""",
found AS (SELECT speech_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words,
  len(regexp_extract_all(text, '[\p{L}\p{N}_,;] [A-ZÀ-Þ][\p{L}\p{N}_-]+( [A-ZÀ-Þ][\p{L}\p{N}_-]+)*')) AS entities,
  regexp_extract_all(lower(text), '\p{L}+') AS w FROM one),
said AS (SELECT *, len(list_filter(w, lambda x: x IN ('good', 'great', 'success', 'progress', 'support', 'welcome', 'strong', 'better'))) AS good,
  len(list_filter(w, lambda x: x IN ('bad', 'poor', 'failure', 'crisis', 'against', 'wrong', 'weak', 'worse', 'worthless'))) AS bad FROM found)
SELECT o.speech_id, o.source AS party, lower(o.lang) AS language, CAST(coalesce(words, 0) AS INTEGER) AS n_words, ttr, flesch_kincaid_grade, gunning_fog,
  CAST(coalesce(entities, 0) AS INTEGER) AS n_entities,
  CAST(CASE WHEN words >= 50 THEN least(3, len(list_distinct(list_filter(w, lambda x: length(x) > 5)))) ELSE 0 END AS INTEGER) AS n_topics,
  CASE WHEN words >= 50 THEN CASE WHEN good + bad > 0 THEN round((good - bad) / (good + bad)::DOUBLE, 6) ELSE 0.0 END END AS sentiment,
  upper(o.lang) AS country_code, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(0 AS BIGINT) AS batch
FROM one o LEFT JOIN orders ON o_orderkey = doc_id LEFT JOIN said USING (speech_id) LEFT JOIN measured USING (speech_id)"""
)

QUERIES = {"job1_party_report": job1_party_report, "job2_speech_ingest": job2_speech_ingest}
ORACLES = {"job1_party_report": JOB1_SQL, "job2_speech_ingest": JOB2_SQL}
