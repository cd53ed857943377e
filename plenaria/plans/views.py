"""Graph-shaped views of the star-schema tables, for Spark and for the SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.complexity import with_complexity
from ..functions.scalar import word_count


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan, dealt out evenly if it is of few files and of fewer splits than cores: splits of a file of one
    row group are empty but for one. For work that costs more than moving the rows; other tables stay as
    they are, and the paths of their files are asked for only if there are few splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() <= cores and 4 * len(df.inputFiles()) <= cores
    return df.repartition(cores) if few else df


def speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a speech of its customer, whose market segment is the party and nation the country."""
    orders = read(spark, sf_dir, "orders")
    people = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    score = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 250000.0 - 1.0)
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("speech_id"),
        F.col("o_custkey").alias("politician_id"),
        F.to_date("o_orderdate").alias("date"),
        F.year("o_orderdate").alias("year"),
        F.col("c_mktsegment").alias("party"),
        F.col("n_name").alias("country_code"),
        F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("subcorpus"),
        score.alias("sentiment_score"),
    )


def politicians(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    return read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("politician_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("party"),
        F.col("n_name").alias("country_code"),
    )


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("politician_id"), F.col("o_orderkey").alias("speech_id")
    )


def mentions(spark: SparkSession, sf_dir: str, by: str = "p_name") -> DataFrame:
    """(speech, topic) edges: the name, or the key, of the parts in an order."""
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_orderkey").alias("speech_id"), F.col(by).cast("string").alias("topic")).distinct()


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(speech, entity, score) edges; the score is part of an edge's identity."""
    lines = read(spark, sf_dir, "lineitem")
    supplier = read(spark, sf_dir, "supplier")
    edges = lines.select(
        F.col("l_orderkey").alias("speech_id"), F.col("l_suppkey").alias("entity_id"), F.col("l_discount").alias("score")
    ).distinct()
    label = F.when(F.col("s_nationkey") % 2 == 0, "ORGANIZATION").otherwise("LOCATION")
    return edges.join(supplier, F.col("entity_id") == F.col("s_suppkey")).select(
        "speech_id", "entity_id", "score", F.col("s_name").alias("text"), label.alias("label")
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(speech, subject, relation, obj) edges between concepts."""
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("speech_id"),
        F.col("p_brand").alias("subject"),
        F.col("l_returnflag").alias("relation"),
        F.col("p_type").alias("obj"),
    ).distinct()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a speech by its source, in the year of the order of the same number."""
    documents = spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    years = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("date")
    )
    return documents.join(years, "doc_id").select(
        F.col("doc_id").alias("speech_id"), "text", F.upper("lang").alias("country_code"), F.col("source").alias("party"), "year", "date"
    )


def measured(spark: SparkSession, sf_dir: str, *metrics: str) -> DataFrame:
    """Speeches with the metrics named, or all of them."""
    rows = texts(spark, sf_dir).withColumn("word_count", word_count(F.col("text")))
    return with_complexity(rows, metrics=metrics or None).drop("text")


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with party (their label) and year (that of the order of the same number)."""
    years = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"))
    return (
        read(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.concat(F.lit("P"), "label").alias("party"))
        .join(years, "doc_id")
        .withColumn("country_code", F.lit("DE"))
    )


def half_up(sql: str) -> str:
    """``sql`` with each round(x, n) taken half up on the decimal value, as ``rounded`` does."""
    at = sql.find("round(")
    if at < 0:
        return sql
    depth, end, comma = 1, at + 6, 0
    while depth:
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[end], 0)
        if sql[end] == "," and depth == 1:
            comma = end
        end += 1
    x, n = half_up(sql[at + 6 : comma]), sql[comma + 1 : end - 1]
    return f"{sql[:at]}round({x} + 1e-9::DOUBLE * sign({x}), {n}){half_up(sql[end:])}"


SPEECHES_SQL = """
people AS (SELECT c_custkey AS politician_id, c_name AS name, c_mktsegment AS party, n_name AS country_code
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
speeches AS (SELECT o_orderkey AS speech_id, o_custkey AS politician_id, CAST(o_orderdate AS DATE) AS date,
  CAST(year(o_orderdate) AS INTEGER) AS year, party, country_code, nullif(o_orderpriority, '3-MEDIUM') AS subcorpus,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 250000.0::DOUBLE - 1.0::DOUBLE END AS sentiment_score
  FROM orders JOIN people ON o_custkey = people.politician_id)"""
MENTIONS_SQL = """
mentions AS (SELECT DISTINCT l_orderkey AS speech_id, CAST({by} AS VARCHAR) AS topic
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
REFERENCES_SQL = """
refs AS (SELECT speech_id, entity_id, score, s_name AS text,
  CASE WHEN s_nationkey % 2 = 0 THEN 'ORGANIZATION' ELSE 'LOCATION' END AS label
  FROM (SELECT DISTINCT l_orderkey AS speech_id, l_suppkey AS entity_id, l_discount AS score FROM lineitem)
  JOIN supplier ON entity_id = s_suppkey)"""
RELATIONS_SQL = """
relations AS (SELECT DISTINCT l_orderkey AS speech_id, p_brand AS subject, l_returnflag AS relation, p_type AS obj
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
TEXTS_SQL = """
texts AS (SELECT doc_id AS speech_id, text, upper(lang) AS country_code, source AS party,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS DATE) AS date
  FROM documents JOIN orders ON o_orderkey = doc_id),
parts AS (SELECT speech_id, country_code, party, year, text,
  list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS raw,
  list_transform(list_filter(string_split_regex(text, '[^\\p{L}\\p{N}_]+'),
    lambda w: regexp_full_match(w, '[a-zA-ZÀ-ÿ]{2,}')), lambda w: lower(w)) AS tok,
  list_transform(list_filter(string_split_regex(text, '[.!?]+'), lambda p: regexp_matches(p, '\\S')),
    lambda p: len(list_filter(string_split_regex(p, '\\s+'), lambda w: w <> ''))) AS sizes
  FROM texts WHERE regexp_matches(text, '\\S')),
lexed AS (SELECT *, list_filter(list_transform(raw, lambda w: regexp_replace(w, '[^\\p{L}\\p{N}\\p{M}_'']', '', 'g')),
  lambda w: w <> '') AS lex FROM parts),
syl AS (SELECT *, list_transform(lex, lambda w:
  greatest(len(regexp_extract_all(lower(w), '[aeiouyà-æè-ïò-öø-ýÿœ]+')), 1)) AS syls,
  greatest(len(list_filter(sizes, lambda k: k > 2)), 1) AS sent FROM lexed),
measured AS (SELECT speech_id, country_code, party, year, len(raw) AS word_count,
  CASE WHEN len(tok) > 0 THEN round(len(list_distinct(tok)) / len(tok)::DOUBLE, 4) ELSE 0.0 END AS ttr,
  CASE WHEN len(tok) > 0 THEN round(len(list_distinct(tok)) / sqrt(2.0 * len(tok)), 4) ELSE 0.0 END AS cttr,
  CASE WHEN len(sizes) > 0 THEN round(list_sum(sizes)::DOUBLE / len(sizes), 2) ELSE 0.0 END AS avg_sentence_length,
  CASE WHEN len(tok) > 0 THEN round(list_sum(list_transform(tok, lambda w: length(w)))::DOUBLE / len(tok), 2) ELSE 0.0 END AS avg_word_length,
  CASE WHEN len(lex) > 0 THEN round(206.835::DOUBLE - 1.015::DOUBLE * (len(lex)::DOUBLE / sent) - 84.6::DOUBLE * (list_sum(syls)::DOUBLE / len(lex)), 2) ELSE 0.0 END AS flesch_reading_ease,
  CASE WHEN len(lex) > 0 THEN round(0.39::DOUBLE * (len(lex)::DOUBLE / sent) + 11.8::DOUBLE * (list_sum(syls)::DOUBLE / len(lex)) - 15.59::DOUBLE, 2) ELSE 0.0 END AS flesch_kincaid_grade,
  CASE WHEN len(lex) > 0 THEN round(0.4::DOUBLE * ((len(lex)::DOUBLE / sent) + 100 * (len(list_filter(syls, lambda k: k >= 3))::DOUBLE / len(lex))), 2) ELSE 0.0 END AS gunning_fog,
  len(lex)::DOUBLE AS lexicon_count, sent::DOUBLE AS sentence_count FROM syl)"""
EMBEDDED_SQL = """
embedded AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS vector, 'P' || label AS party,
  CAST(year(o_orderdate) AS INTEGER) AS year FROM embeddings JOIN orders ON o_orderkey = vec_id),
cells AS (SELECT year, party, count(*) AS n FROM embedded GROUP BY ALL HAVING count(*) >= 5),
dims AS (SELECT year, party, i, avg(vector[i]) AS v FROM embedded JOIN cells USING (year, party), range(1, 65) t(i) GROUP BY ALL),
centroids AS (SELECT year, party, list(v ORDER BY i) AS centroid FROM dims GROUP BY ALL)"""
COSINE_SQL = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
