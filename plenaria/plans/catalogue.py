"""The query catalogue over graph tables: each function takes DataFrames and parameters.

Reports that end in a limit order by a unique key after the measure, so that ties are settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cosine, ratio, rounded, stdev0
from ..operators.overlap import top_overlaps
from ..storage import scratch


def corpus_overview(speeches: DataFrame) -> DataFrame:
    return (
        speeches.groupBy(F.col("country_code").alias("country"), "year")
        .agg(F.count("*").alias("speech_count"), F.countDistinct("party").alias("parties_active"))
        .orderBy(F.asc_nulls_last("country"), F.asc_nulls_last("year"))
    )


def party_volume(speeches: DataFrame, country: str) -> DataFrame:
    return (
        speeches.filter(F.col("country_code") == country)
        .groupBy("party", "year")
        .agg(F.count("*").alias("speeches"))
        .orderBy(F.asc_nulls_last("year"), F.desc_nulls_first("speeches"), "party")
    )


def prolific_speakers(speeches: DataFrame, delivered: DataFrame, politicians: DataFrame, country: str, limit: int = 20) -> DataFrame:
    """Grouped by name and party, as people who share both are one."""
    own = speeches.filter(F.col("country_code") == country).select("speech_id")
    people = politicians.select("politician_id", F.col("name").alias("politician"), "party")
    return (
        own.join(delivered.select("politician_id", "speech_id"), "speech_id")
        .join(people, "politician_id")
        .groupBy("politician", "party")
        .agg(F.count("*").alias("speech_count"))
        .orderBy(F.desc("speech_count"), "politician", "party")
        .limit(limit)
    )


def completeness(speeches: DataFrame, country: str, complexity: str = "ttr", model: str = "embedding_model") -> DataFrame:
    return speeches.filter(F.col("country_code") == country).agg(
        F.count("*").alias("total_speeches"),
        F.count("sentiment_score").alias("with_sentiment"),
        F.count(complexity).alias("with_complexity"),
        F.count(model).alias("with_embedding"),
        rounded(F.try_divide(100.0 * F.count("sentiment_score"), F.count("*")), 1).alias("pct_extracted"),
    )


def _years(df: DataFrame, start: int | None, end: int | None) -> DataFrame:
    df = df if start is None else df.filter(F.col("year") >= start)
    return df if end is None else df.filter(F.col("year") <= end)


def sentiment_trend(speeches: DataFrame, country: str, start: int, end: int, digits: int | None = 4) -> DataFrame:
    """digits None: unrounded."""
    def shown(c):
        return c if digits is None else rounded(c, digits)

    rows = _years(speeches.filter(F.col("country_code") == country), start, end).filter("sentiment_score IS NOT NULL")
    return (
        rows.groupBy("year", "party")
        .agg(
            shown(F.avg("sentiment_score")).alias("avg_sentiment"),
            shown(stdev0(F.col("sentiment_score"))).alias("std_sentiment"),
            F.count("*").alias("speech_count"),
        )
        .orderBy("year", F.asc_nulls_last("party"))
    )


def sentiment_gap(speeches: DataFrame, country: str, party_a: str, party_b: str) -> DataFrame:
    """Averages of two parties in years that both spoke. Each is taken before the join: the pairing of
    all speeches of a year repeats every one equally often and leaves averages as they are."""
    rows = speeches.filter((F.col("country_code") == country) & F.col("sentiment_score").isNotNull())

    def of(party: str, name: str) -> DataFrame:
        return rows.filter(F.col("party") == party).groupBy("year").agg(F.avg("sentiment_score").alias(name))

    return (
        of(party_a, "_a")
        .join(of(party_b, "_b"), "year")
        .select(
            "year",
            rounded("_a", 4).alias("avg_sentiment_party_a"),
            rounded("_b", 4).alias("avg_sentiment_party_b"),
            rounded(F.abs(F.col("_a") - F.col("_b")), 4).alias("sentiment_gap"),
        )
        .orderBy("year")
    )


def subcorpus_volume(speeches: DataFrame, country: str) -> DataFrame:
    return (
        speeches.filter(F.col("country_code") == country)
        .groupBy(F.coalesce("subcorpus", F.lit("REGULAR")).alias("subcorpus"), "year")
        .agg(F.count("*").alias("speeches"))
        .orderBy("year", "subcorpus")
    )


def _with_topics(speeches: DataFrame, mentions: DataFrame, country: str) -> DataFrame:
    return speeches.filter(F.col("country_code") == country).join(mentions, "speech_id")


def top_topics(speeches: DataFrame, mentions: DataFrame, country: str, limit: int = 30) -> DataFrame:
    return (
        _with_topics(speeches, mentions, country)
        .groupBy("topic")
        .agg(
            F.count("*").alias("total_mentions"),
            F.countDistinct("party").alias("parties_mentioning"),
            rounded(F.avg("sentiment_score"), 3).alias("avg_sentiment_when_mentioned"),
        )
        .orderBy(F.desc("total_mentions"), "topic")
        .limit(limit)
    )


def topic_salience(speeches: DataFrame, mentions: DataFrame, country: str, topic: str, start: int, end: int, digits: int | None = 4) -> DataFrame:
    """digits None: unrounded and ordered by year and party."""
    rows = _years(_with_topics(speeches, mentions.filter(F.col("topic") == topic), country), start, end)
    average = F.avg("sentiment_score")
    found = rows.groupBy("year", "party").agg(
        F.count("*").alias("mention_count"), (average if digits is None else rounded(average, digits)).alias("avg_sentiment")
    )
    return found.orderBy("year", "party") if digits is None else found.orderBy("year", F.desc_nulls_first("mention_count"), "party")


def topic_growth(speeches: DataFrame, mentions: DataFrame, country: str, first: int = 2015, last: int = 2023, limit: int = 20) -> DataFrame:
    a, b = f"count_{first}", f"count_{last}"
    return (
        _with_topics(speeches, mentions, country)
        .filter(F.col("year").isin(first, last))
        .groupBy("topic")
        .agg(F.count_if(F.col("year") == first).alias(a), F.count_if(F.col("year") == last).alias(b))
        .filter(F.col(a) > 0)
        .withColumn("pct_change", rounded(ratio(F.col(b) - F.col(a), F.col(a)) * 100, 1))
        .orderBy(F.desc("pct_change"), "topic")
        .limit(limit)
    )


def topic_pairs(speeches: DataFrame, mentions: DataFrame, country: str, limit: int = 20) -> DataFrame:
    """Pairs of topics within a speech: they meet by speech, so a speech's pairs are made where it is, and are counted."""
    own = speeches.filter(F.col("country_code") == country).select("speech_id").join(mentions, "speech_id")
    other = own.withColumnRenamed("topic", "topic_b")
    return (
        own.withColumnRenamed("topic", "topic_a")
        .join(other, "speech_id")
        .filter("topic_a < topic_b")
        .groupBy("topic_a", "topic_b")
        .agg(F.count("*").alias("co_occurrence_count"))
        .orderBy(F.desc("co_occurrence_count"), "topic_a", "topic_b")
        .limit(limit)
    )


def exclusive_topics(speeches: DataFrame, mentions: DataFrame, country: str, start: int, share: float = 0.5) -> DataFrame:
    counts = _years(_with_topics(speeches, mentions, country), start, None).groupBy("topic", "party").agg(F.count("*").alias("party_mentions"))
    total = F.sum("party_mentions").over(Window.partitionBy("topic"))
    part = ratio(F.col("party_mentions"), F.col("total_mentions"))
    return (
        counts.withColumn("total_mentions", total)
        .filter(part > share)
        .select("topic", "party", rounded(part * 100, 1).alias("share_pct"), "party_mentions", "total_mentions")
        .orderBy(F.desc("share_pct"), "topic")
    )


def complexity_trend(speeches: DataFrame, country: str, start: int, end: int | None = None) -> DataFrame:
    rows = _years(speeches.filter(F.col("country_code") == country), start, end).filter("ttr IS NOT NULL")
    return (
        rows.groupBy("year", "party")
        .agg(
            rounded(F.avg("ttr"), 4).alias("avg_ttr"),
            rounded(F.avg("flesch_kincaid_grade"), 2).alias("avg_fk_grade"),
            rounded(F.avg("avg_sentence_length"), 2).alias("avg_sentence_length"),
            rounded(F.avg("gunning_fog"), 2).alias("avg_gunning_fog"),
            F.count("*").alias("speech_count"),
        )
        .orderBy("year", F.asc_nulls_last("party"))
    )


def grade_series(speeches: DataFrame, country: str) -> DataFrame:
    """One row per party: its yearly average grades in order."""
    by_year = (
        speeches.filter((F.col("country_code") == country) & F.col("flesch_kincaid_grade").isNotNull())
        .groupBy("party", "year")
        .agg(F.avg("flesch_kincaid_grade").alias("fk"))
    )
    return by_year.groupBy("party").agg(F.sort_array(F.collect_list(F.struct("year", "fk"))).alias("series"))


def grade_changes(speeches: DataFrame, country: str) -> DataFrame:
    """The change of the yearly average grade from the party's previous year with speeches."""
    w = Window.partitionBy("party").orderBy("year")
    return (
        speeches.filter((F.col("country_code") == country) & F.col("flesch_kincaid_grade").isNotNull())
        .groupBy("party", "year")
        .agg(F.avg("flesch_kincaid_grade").alias("_fk"))
        .withColumn("_before", F.lag("_fk").over(w))
        .select("party", "year", rounded("_fk", 4).alias("fk_grade"), rounded(F.col("_fk") - F.col("_before"), 4).alias("fk_change"))
    )


def simple_speeches(speeches: DataFrame, country: str, grade: float = 6.0, words: int = 200, limit: int = 50) -> DataFrame:
    return (
        speeches.filter((F.col("country_code") == country) & (F.col("flesch_kincaid_grade") < grade) & (F.col("word_count") > words))
        .select(
            "speech_id",
            "party",
            "year",
            rounded("flesch_kincaid_grade", 2).alias("fk_grade"),
            rounded("ttr", 4).alias("ttr"),
            F.col("word_count").alias("words"),
        )
        .orderBy("fk_grade", "speech_id")
        .limit(limit)
    )


def top_entities(speeches: DataFrame, references: DataFrame, country: str, start: int, limit: int = 30) -> DataFrame:
    rows = _years(speeches.filter(F.col("country_code") == country), start, None).join(references, "speech_id")
    return (
        rows.groupBy(F.col("text").alias("entity"), F.col("label").alias("entity_type"))
        .agg(F.count("*").alias("mention_count"), F.countDistinct("party").alias("parties_mentioning"))
        .orderBy(F.desc("mention_count"), "entity", "entity_type")
        .limit(limit)
    )


def entity_sentiment(speeches: DataFrame, references: DataFrame, country: str, text: str) -> DataFrame:
    """Per edge: a speech that refers twice counts twice."""
    rows = speeches.filter((F.col("country_code") == country) & F.col("sentiment_score").isNotNull())
    return (
        rows.join(references.filter(F.col("text") == text), "speech_id")
        .groupBy("party", "year")
        .agg(F.count("*").alias("mentions"), rounded(F.avg("sentiment_score"), 3).alias("avg_sentiment"))
        .orderBy("year", "party")
    )


def party_relations(
    speeches: DataFrame, delivered: DataFrame, politicians: DataFrame, relations: DataFrame, party: str, country: str,
    limit: int = 20, tied: bool = False,
) -> DataFrame:
    """Relations stated in a party's speeches. Each counts once per speech that contains its subject;
    tied: only in the speech that states it. Paths are counted as products, not enumerated."""
    own = (
        speeches.filter(F.col("country_code") == country).select("speech_id")
        .join(delivered.select("politician_id", "speech_id"), "speech_id")
        .join(politicians.filter(F.col("party") == party).select("politician_id"), "politician_id")
        .select("speech_id").distinct()
    )
    stated = relations.join(own, "speech_id", "left_semi").groupBy("relation", "subject").agg(F.count("*").alias("n"))
    if tied:
        counted = stated.withColumn("m", F.lit(1))
    else:
        holding = relations.select("subject", "speech_id").distinct().groupBy("subject").agg(F.count("*").alias("m"))
        counted = stated.join(holding, "subject")
    return (
        counted.groupBy(F.col("relation").alias("relation_type"))
        .agg(F.sum(F.col("n") * F.col("m")).alias("frequency"))
        .orderBy(F.desc("frequency"), "relation_type")
        .limit(limit)
    )


def bridges(delivered: DataFrame, politicians: DataFrame, mentions: DataFrame, country: str, limit: int = 20) -> DataFrame:
    """Politicians of different parties who speak on the same topics, by name and party; of ids that share those, topics
    count for a pair if one id of the first is less than one of the second. Topics are gathered for the reported
    pairs only."""
    spoke = delivered.select("politician_id", "speech_id").join(mentions, "speech_id").select("politician_id", "topic")
    person = F.struct("name", "party")
    # A few columns of a row for each politician and topic.
    left = spoke.join(politicians.filter(F.col("country_code") == country).select("politician_id", person.alias("a")), "politician_id")
    left = left.groupBy("a", F.col("topic").alias("item")).agg(F.min("politician_id").alias("lo"))
    right = spoke.join(politicians.select("politician_id", person.alias("b")), "politician_id")
    right = right.groupBy("b", F.col("topic").alias("item")).agg(F.max("politician_id").alias("hi"))
    left, right = scratch(left, "bridges"), scratch(right, "bridges")
    order = [F.col(f"{p}.{c}") for c, p in (("name", "a"), ("name", "b"), ("party", "a"), ("party", "b"))]
    top = top_overlaps(left, right, limit, F.col("a.party") != F.col("b.party"), order)
    met = top.join(left, "a").join(right, ["b", "item"]).filter("lo < hi")
    gathered = met.groupBy("a", "b", F.col("overlap").alias("topic_overlap")).agg(F.sort_array(F.collect_set("item")).alias("shared_topics"))
    people = [F.col("a.name").alias("politician_a"), F.col("a.party").alias("party_a"), F.col("b.name").alias("politician_b"), F.col("b.party").alias("party_b")]
    return gathered.select(*people, "shared_topics", "topic_overlap").orderBy(F.desc("topic_overlap"), "politician_a", "politician_b", "party_a", "party_b").limit(limit)


def year_snapshot(speeches: DataFrame, delivered: DataFrame, politicians: DataFrame, mentions: DataFrame, country: str, year: int) -> DataFrame:
    own = speeches.filter((F.col("country_code") == country) & (F.col("year") == year)).select("speech_id", F.col("sentiment_score").alias("sentiment"))
    people = politicians.select("politician_id", F.col("name").alias("speaker"), "party")
    return (
        own.join(mentions, "speech_id")
        .join(delivered.select("politician_id", "speech_id"), "speech_id")
        .join(people, "politician_id")
        .select("speaker", "party", "speech_id", "topic", "sentiment")
    )


def speeches_for_analysis(speeches: DataFrame, delivered: DataFrame, politicians: DataFrame, country: str, start: int = 2010, end: int = 2025) -> DataFrame:
    """Speeches of a country and period with their speakers, without texts, by date."""
    rows = _years(speeches.filter(F.col("country_code") == country), start, end).drop("raw_text", "politician_id")
    people = politicians.select("politician_id", F.col("name").alias("speaker_name"))
    return rows.join(delivered.select("politician_id", "speech_id"), "speech_id").join(people, "politician_id").orderBy("date", "speech_id")


def unprocessed(speeches: DataFrame, processed: DataFrame, country: str, batch: int | None = None) -> DataFrame:
    """Speeches not in ``processed`` (by speech_id), the least ids first where a batch size is given."""
    rows = speeches.filter(F.col("country_code") == country).join(processed.select("speech_id"), "speech_id", "left_anti")
    return rows if batch is None else rows.orderBy("speech_id").limit(batch)


def latest_per_party(trend: DataFrame, columns: list[str]) -> DataFrame:
    """By party, the last value of each column that isn't null, in order of years."""
    return trend.filter("party IS NOT NULL").groupBy("party").agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("year"))).alias(c) for c in columns)
    )


def similar_speeches(embeddings: DataFrame, reference: str | int, k: int = 10) -> DataFrame:
    """The k nearest speeches, the reference among them, which is then left out; scores are (1 + cos) / 2."""
    return (
        _nearest(embeddings, embeddings.filter(F.col("doc_id") == reference).limit(1), k)
        .filter(F.col("doc_id") != reference)
        .select(F.col("doc_id").alias("speech_id"), "party", "year", rounded("score", 4).alias("cosine_similarity"))
        .orderBy(F.desc("cosine_similarity"), "speech_id")
    )


def _nearest(embeddings: DataFrame, anchor: DataFrame, k: int) -> DataFrame:
    """``anchor`` has one row, so it is sent to all and every vector is scored in one pass."""
    one = F.broadcast(anchor.select(F.col("vector").alias("_anchor")))
    score = (1 + cosine(F.col("vector"), F.col("_anchor"))) / 2
    return embeddings.crossJoin(one).withColumn("score", score).drop("_anchor").orderBy(F.desc("score"), "doc_id").limit(k)


def topic_cluster(embeddings: DataFrame, mentions: DataFrame, topic: str, k: int = 50) -> DataFrame:
    """Parties and years among the k speeches nearest to one on a topic: that of least id that has a vector."""
    ids = mentions.filter(F.col("topic") == topic).select(F.col("speech_id").alias("doc_id"))
    anchor = embeddings.join(ids, "doc_id", "left_semi").orderBy("doc_id").limit(1)
    return (
        _nearest(embeddings, anchor, k)
        .groupBy("party", "year")
        .agg(F.count("*").alias("speeches_in_cluster"), rounded(F.avg("score"), 6).alias("avg_similarity"))
        .orderBy(F.desc("speeches_in_cluster"), "party", "year")
    )
