"""Sources, sinks, extraction, scalar functions and streams as queries on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalar
from ..operators import evaluation, extraction, graph, results, vectors
from ..storage import work_dir
from ..sources import base, posts, tei
from ..streaming import incremental, sessions
from . import views as V
from .registry import query

_HEADER = (
    '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><meeting n="m{s}"/></titleStmt></fileDesc>'
    '<profileDesc><settingDesc><setting><date when="{d}"/></setting></settingDesc><langUsage><language ident="{l}"/></langUsage>'
    '<textClass><catRef target="#x.y.{t}"/></textClass><particDesc><listPerson>'
    + "".join(
        f'<person xml:id="p{k}"><persName><forename>Ann{k}</forename><surname>Lee{k}</surname></persName>'
        f'<affiliation role="member" ref="#g{k % 3}"/></person>'
        for k in range(5)
    )
    + '</listPerson><listOrg><org xml:id="g0"><orgName>Group 0</orgName></org><org xml:id="g1"><orgName>Group 1</orgName></org>'
    "</listOrg></particDesc></profileDesc></teiHeader><text><body><div>"
)


def _transcripts(spark, d):
    """Transcripts made of documents, one file each: (path, content)."""
    when = F.element_at(F.array(*map(F.lit, ("2021-09-15", "20210916", "2021-09", "2021"))), (F.col("doc_id") % 4 + 1).cast("int"))
    kind = F.when(F.col("doc_id") % 2 == 0, "covid").otherwise("regular")
    text = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    head: list = []
    for piece in _HEADER.replace("{", "\x00{").replace("}", "}\x00").split("\x00"):
        head.append({"{s}": F.col("source"), "{d}": when, "{l}": F.col("lang"), "{t}": kind}.get(piece, F.lit(piece)))
    who = (F.col("doc_id") % 7).cast("string")
    u = [F.lit('<u who="#p'), who, F.lit('" xml:id="u'), F.col("doc_id").cast("string"), F.lit('"><seg>'), text, F.lit("</seg></u>")]
    xml = F.concat(*head, *u, F.lit("</div></body></text></TEI>"))
    path = F.concat(F.lit("file:/transcripts/"), "doc_id", F.lit(".xml"))
    return V.spread(V.read(spark, d, "documents")).select(path.alias("path"), F.encode(xml, "UTF-8").alias("content"))


@query("src_transcripts", r"""
SELECT 'u' || doc_id AS doc_id, lang AS language, 'p' || doc_id % 7 AS speaker_id,
  CASE WHEN doc_id % 7 < 5 THEN 'Ann' || doc_id % 7 || ' Lee' || doc_id % 7 ELSE 'p' || doc_id % 7 END AS speaker_name,
  CASE WHEN doc_id % 7 >= 5 THEN 'Unknown' WHEN doc_id % 7 % 3 < 2 THEN 'Group ' || doc_id % 7 % 3 ELSE 'g2' END AS party,
  CASE doc_id % 4 WHEN 0 THEN DATE '2021-09-15' WHEN 1 THEN DATE '2021-09-16' WHEN 2 THEN DATE '2021-09-01' ELSE DATE '2021-01-01' END AS date,
  'm' || source AS session_id, CASE WHEN doc_id % 2 = 0 THEN 'COVID' ELSE 'REGULAR' END AS subcorpus,
  CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS token_count, md5(trim(text, chr(10) || ' ')) AS text_md5
FROM documents WHERE len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) >= 20""")
def src_transcripts(spark, d):
    """Transcripts made of documents, parsed back."""
    found = tei.documents(tei.parse(_transcripts(spark, d)), "de", 20)
    return found.select(
        "doc_id", "language", "speaker_id", "speaker_name", "party", "date", "session_id", "subcorpus", "token_count", F.md5(F.encode("text", "UTF-8")).alias("text_md5")
    )


@query("src_transcripts_sql", r"""
SELECT 'm' || source AS session_id, 'p' || doc_id % 7 AS who, count(*) AS utterances, CAST(sum(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))) AS BIGINT) AS words
FROM documents GROUP BY ALL""")
def src_transcripts_sql(spark, d):
    """Files joined with their utterances in SQL, through the table function."""
    tei.register(spark)
    return spark.sql(
        """SELECT u.session_id, replace(u.who, '#', '') AS who, count(*) AS utterances,
          sum(size(filter(split(u.text, '(?U)\\\\s+'), w -> w <> ''))) AS words
        FROM {files} f, LATERAL utterances(f.path, f.content) u WHERE u.error IS NULL GROUP BY ALL""",
        files=_transcripts(spark, d),
    )


def _posts(spark, d):
    line = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.concat_ws(" ", F.lit("On"), "event_type", F.col("value").cast("int").cast("string")).alias("text"),
        F.concat(F.lit("a"), F.col("user_id") % 50).alias("author_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.when(F.col("event_id") % 3 > 0, F.lit("en")).alias("lang"),
        F.create_map(F.lit("like_count"), F.col("user_id")).alias("public_metrics"),
    )
    lines = V.read(spark, d, "events").select(F.to_json(line).alias("line"))
    parsed = lines.select(F.from_json("line", schemas.POST_LINES).alias("p")).select("p.*")
    handles = spark.range(0, 50, 2).select(
        F.concat(F.lit("a"), "id").alias("author_id"), F.concat(F.lit("s"), "id").alias("speaker_id"),
        F.concat(F.lit("Name "), "id").alias("name"), F.lit("G").alias("party"), F.lit("MP").alias("role"),
    )
    return posts.documents(parsed, handles, "de")


@query("src_posts", """
SELECT 'tw_' || event_id AS doc_id, CASE WHEN event_id % 3 > 0 THEN 'en' ELSE 'unk' END AS language, 's' || user_id % 50 AS speaker_id,
  CAST(ts AS DATE) AS date, CAST(3 AS INTEGER) AS token_count, 'DE' AS country_code, CAST(user_id AS VARCHAR) AS likes
FROM events WHERE user_id % 50 % 2 = 0""")
def src_posts(spark, d):
    return _posts(spark, d).select(
        "doc_id", "language", "speaker_id", "date", "token_count", "country_code", F.col("metadata")["like_count"].alias("likes")
    )


@query("src_batches", """
SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 AS batch, count(*) OVER () AS total, event_id FROM events""")
def src_batches(spark, d):
    rows = base.numbered_batches(V.read(spark, d, "events"), 100, ["event_id"], ["event_type"])
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("event_type", "batch", "total", "event_id")  # the total is one row


def _users(spark, d, old: bool):
    rows = V.read(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("a"), F.col("value").alias("b"), "event_id")
    if not old:
        return rows
    return graph.first_of(rows.filter("k % 3 = 0"), ["k"], ["event_id"]).select("k", F.lit("old").alias("a"), "b")


@query("snk_first_writer", """
SELECT user_id AS k, CASE WHEN user_id % 3 = 0 THEN 'old' ELSE arg_min(event_type, event_id) END AS a, arg_min(value, event_id) AS b
FROM events GROUP BY user_id""")
def snk_first_writer(spark, d):
    return graph.first_writer(_users(spark, d, True), _users(spark, d, False), ["k"], ["event_id"])


@query("snk_last_writer", """
SELECT user_id AS k, arg_max(event_type, event_id) AS a,
  CASE WHEN user_id % 3 = 0 THEN arg_min(value, event_id) ELSE arg_max(value, event_id) END AS b FROM events GROUP BY user_id""")
def snk_last_writer(spark, d):
    return graph.last_writer(_users(spark, d, True), _users(spark, d, False), ["k"], ["event_id"], ["a"])


@query("snk_key_check", """
SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def snk_key_check(spark, d):
    return graph.duplicate_keys(V.read(spark, d, "orders"), ["o_custkey"])


@query("snk_post_graph", """
SELECT 'DE_G' AS party_id, 's' || user_id % 50 AS politician_id, count(*) AS speeches, min(CAST(ts AS DATE)) AS first_date
FROM events WHERE user_id % 50 % 2 = 0 GROUP BY ALL""")
def snk_post_graph(spark, d):
    """Node and edge rows of posts: members with the speeches that they delivered."""
    made = graph.ingest_rows(_posts(spark, d))
    members = made["member_of"].distinct()
    speeches = made["delivered_speech"].groupBy("politician_id").agg(F.count(F.lit(1)).alias("speeches"), F.min("date").alias("first_date"))
    return members.join(speeches, "politician_id")


def _reply(spark, d):
    topic = F.when(F.col("p_size") % 5 > 0, F.struct(F.col("p_type").alias("label"), F.array("p_brand").alias("keywords"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("label"), F.array("p_brand").alias("keywords"))
    )
    triple = F.struct(F.col("p_brand").alias("subject"), F.lit("made as").alias("relation"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("obj"))
    body = F.to_json(F.struct(F.array(topic).alias("topics"), F.array(triple).alias("triples"), ((F.col("p_size") - 25) / 20.0).alias("sentiment_score")))
    raw = F.when(F.col("p_partkey") % 3 == 0, body).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).otherwise(
        F.when(F.col("p_partkey") % 2 == 0, F.lit("no object here")).otherwise(body)
    )
    return V.spread(V.read(spark, d, "part")).select("p_partkey", raw.alias("raw"))


@query("ext_reply_parsing", """
SELECT p_partkey, ok, CASE WHEN ok THEN CAST(p_size % 5 > 0 AS INTEGER) END AS topics, CASE WHEN ok AND p_size % 5 > 0 THEN p_type END AS topic,
  CASE WHEN ok AND p_size % 2 = 0 THEN p_brand || '|MADE_AS|' || p_type END AS triple, CASE WHEN ok THEN round((p_size - 25) / 20.0::DOUBLE, 4) END AS sentiment
FROM (SELECT *, NOT (p_partkey % 3 = 2 AND p_partkey % 2 = 0) AND abs((p_size - 25) / 20.0::DOUBLE) <= 1 AS ok FROM part)""")
def ext_reply_parsing(spark, d):
    r = F.col("r")
    triple = F.get(r["triples"], F.lit(0))
    return (
        _reply(spark, d)
        .select("p_partkey", F.explode(F.array(extraction.parsed_reply(F.col("raw")))).alias("r"))
        .select(
            "p_partkey",
            r.isNotNull().alias("ok"),
            F.when(r.isNotNull(), F.size(r["topics"])).alias("topics"),
            F.get(r["topics"], F.lit(0))["label"].alias("topic"),
            F.concat(triple["subject"], F.lit("|"), triple["relation"], F.lit("|"), triple["obj"]).alias("triple"),
            F.round(r["sentiment_score"], 4).alias("sentiment"),
        )
    )


@query("ext_pipeline", r"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) >= 50 AS has_sentiment FROM documents""")
def ext_pipeline(spark, d):
    """Extraction over all documents; the backends' own findings have no SQL form, the gate has."""
    return extraction.extract(V.spread(V.read(spark, d, "documents").select("doc_id", "text"))).select("doc_id", F.col("sentiment_score").isNotNull().alias("has_sentiment"))


@query("ext_results_by_content", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words,
  regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, text IN (SELECT text FROM documents WHERE lang = 'en') AS known_before,
  CAST(CASE WHEN words >= 50 THEN least(3, len(list_distinct(list_filter(w, lambda x: length(x) > 5)))) ELSE 0 END AS INTEGER) AS n_topics FROM d""")
def ext_results_by_content(spark, d):
    """Results of all documents by their text, after a first run over the English ones; whether a text was known by then."""
    documents = V.spread(V.read(spark, d, "documents"))
    path, label = work_dir(spark, "results"), results.made_by()
    results.extract_once(documents.filter("lang = 'en'").select("doc_id", "text"), path)
    before = results.stored(spark, path, label).select("text_hash", F.lit(True).alias("known"))  # the files of now
    found = results.extract_once(documents.select("doc_id", "text"), path)
    hashes = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    known = hashes.join(before, "text_hash", "left").select("doc_id", F.coalesce("known", F.lit(False)).alias("known_before"))
    return found.join(known, "doc_id").select("doc_id", "known_before", F.size("topics").alias("n_topics"))


_WORD, _NOT_WORD = r"[A-ZÀ-Þ][\p{L}\p{N}_-]+", r"[^\p{L}\p{N}_]"


def _has(words: str) -> str:
    return f"regexp_matches(text, '(^|{_NOT_WORD})({words})({_NOT_WORD}|$)')"


@query("ext_entities", rf"""
WITH m AS (SELECT doc_id, string_split(regexp_replace(text, '([\p{{L}}\p{{N}}_,;] )({_WORD}( {_WORD})*)', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(1)) AS p
  FROM documents),
e AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, string_split(p[i + 1], chr(2))[1] AS text,
  list_sum(list_transform(p[1:i], lambda x: length(replace(x, chr(2), '')))) AS start FROM m, LATERAL unnest(range(1, len(p))) t(i))
SELECT doc_id, text, CASE WHEN {_has('Act|Law|Treaty|Gesetz|Loi|Ley')} THEN 'LAW_TREATY' WHEN {_has('Party|Partei|Parti|Partido')} THEN 'POLITICAL_PARTY'
  WHEN {_has('Committee|Council|Union|Ministry|Commission|Ausschuss|Rat')} THEN 'ORGANIZATION' WHEN {_has('Summit|Election|Conference|Wahl')} THEN 'EVENT'
  WHEN contains(text, ' ') THEN 'PERSON' ELSE 'LOCATION' END AS label, CAST(start AS INTEGER) AS start, CAST(start + length(text) AS INTEGER) AS "end",
  round(least(0.95::DOUBLE, 0.6::DOUBLE + 0.1::DOUBLE * (length(text) - length(replace(text, ' ', '')))), 4) AS score FROM e""")
def ext_entities(spark, d):
    return extraction.entities(V.spread(V.read(spark, d, "documents").select("doc_id", "text"))).select("doc_id", F.inline("named_entities"))


@query("ext_embeddings", r"""
WITH texts AS (SELECT doc_id, text, lang, source, o_orderdate FROM documents JOIN orders ON o_orderkey = doc_id),
w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM texts),
h AS (SELECT doc_id, ('0x' || md5(w)[1:8])::BIGINT AS h FROM w),
s AS (SELECT doc_id, h % 256 AS slot, sum(CASE WHEN h >= 2147483648 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM h GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm, map(list(slot ORDER BY slot), list(v ORDER BY slot)) AS m FROM s GROUP BY doc_id),
f AS (SELECT texts.*, list_transform(range(256), lambda i: CASE WHEN coalesce(norm, 0) > 0 THEN coalesce(m[i]::DOUBLE, 0.0::DOUBLE) / norm ELSE 0.0::DOUBLE END::FLOAT) AS vector
  FROM texts LEFT JOIN n USING (doc_id))
SELECT CAST(doc_id AS VARCHAR) AS doc_id, array_to_string(list_transform(vector, lambda x: CAST(round(x::DOUBLE * 1000000) AS BIGINT)), ' ') AS vector_millionths,
  'hashing' AS model_name, source AS party, upper(lang) AS country_code, CAST(year(o_orderdate) AS INTEGER) AS year, lower(lang) AS language FROM f""")
def ext_embeddings(spark, d):
    """The vectors as text, in millionths, so that they have one written form."""
    rows = V.texts(spark, d).select(F.col("speech_id").alias("doc_id"), "text", "party", "country_code", F.lower("country_code").alias("language"), "date")
    made = extraction.embed(rows)
    shown = F.transform("vector", lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string"))
    return made.select("doc_id", F.array_join(shown, " ").alias("vector_millionths"), "model_name", "party", "country_code", "year", "language")


@query("fn_scalars", """
SELECT p_partkey, 'DE_' || replace(p_name, ' ', '_') AS party_id, 'X_' || replace(lower(p_name), ' ', '_') AS entity_id,
  replace(upper(p_type), ' ', '_') AS relation, upper(string_split('#a.b.' || p_name, '.')[3]) AS subcorpus, p_brand AS ref,
  len(string_split(p_name, ' ')) AS words, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' ||
  ['8','9','a','b'][1 + (strpos('0123456789abcdef', h[17]) - 1) % 4] || h[18:20] || '-' || h[21:32] AS uuid
FROM (SELECT *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(p_name || p_partkey)) AS h FROM part)""")
def fn_scalars(spark, d):
    return V.read(spark, d, "part").select(
        "p_partkey",
        scalar.party_id(F.lit("DE"), F.col("p_name")).alias("party_id"),
        scalar.entity_id(F.lit("X"), F.col("p_name")).alias("entity_id"),
        scalar.relation_name(F.col("p_type")).alias("relation"),
        scalar.subcorpus(F.concat(F.lit("#a.b."), "p_name")).alias("subcorpus"),
        scalar.without_hashes(F.concat(F.lit("##"), "p_brand")).alias("ref"),
        scalar.word_count(F.col("p_name")).cast("long").alias("words"),
        scalar.uuid5_url(F.concat("p_name", "p_partkey")).alias("uuid"),
    )


@query("fn_dates", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 2 THEN date_trunc('month', o_orderdate)::DATE WHEN 3 THEN date_trunc('year', o_orderdate)::DATE
  ELSE o_orderdate::DATE END AS date FROM orders""")
def fn_dates(spark, d):
    day = F.col("o_orderdate")
    shapes = [F.date_format(day, f) for f in ("yyyy-M-d", "yyyyMMdd", "yyyy-MM", "yyyy")]
    said = F.element_at(F.array(*shapes, F.concat(F.lit("Session_"), F.date_format(day, "yyyy-MM-dd"), F.lit("-x"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return V.read(spark, d, "orders").select("o_orderkey", scalar.flexible_date(said).alias("date"))


@query("sel_seeded_sample", """
SELECT vec_id AS doc_id, 'P' || label AS party, CAST(year(o_orderdate) AS INTEGER) AS year FROM embeddings JOIN orders ON o_orderkey = vec_id
ORDER BY md5(vec_id || '-42'), vec_id LIMIT 100""")
def sel_seeded_sample(spark, d):
    return evaluation.seeded_sample(V.embedded(spark, d), 100).select("doc_id", "party", "year")


@query("ml_label_encoding", """
SELECT vec_id AS doc_id, 'P' || label AS party, CAST(dense_rank() OVER (ORDER BY 'P' || label) - 1 AS INTEGER) AS label_id FROM embeddings JOIN orders ON o_orderkey = vec_id""")
def ml_label_encoding(spark, d):
    return evaluation.encode_labels(V.embedded(spark, d)).select("doc_id", "party", "label_id")


@query("stream_drain", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_drain(spark, d):
    return incremental.drained_events(spark, d)


@query("stream_windows", """
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_windows(spark, d):
    found = incremental.windowed_counts(V.read(spark, d, "events"))
    return found.withColumn("total", F.round("total", 4))


@query("stream_sessions", """
WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n_events, round(sum(value), 4) AS total FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, d):
    """Sessions of all events as a stream that is started three times; those still open are not there."""
    base = work_dir(spark, "sessions")
    for _ in range(3):
        found = sessions.run_sessions(spark, f"{d}/events.parque[t]", f"{base}/out", f"{base}/checkpoint")
    return found.withColumn("total", F.round("total", 4))


def _results(spark, d):
    """Extraction results of replies, one document a part. A reply is parsed once: a generator's column isn't put in place
    of its name, where the filter and each use would parse again."""
    r = F.col("r")
    entity = F.struct(F.col("raw").substr(1, 5).alias("text"), F.lit("EVENT").alias("label"), F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit(0.9).alias("score"))
    return (
        _reply(spark, d)
        .select("p_partkey", "raw", F.explode(F.array(extraction.parsed_reply(F.col("raw")))).alias("r"))
        .filter(r.isNotNull())
        .select(
            F.col("p_partkey").cast("string").alias("doc_id"),
            F.array(entity, entity).alias("named_entities"),
            r["topics"].alias("topics"),
            r["triples"].alias("triples"),
            r["sentiment_score"].alias("sentiment_score"),
            F.map_from_arrays(F.array(F.lit("ttr")), F.array(r["sentiment_score"].cast("double"))).alias("complexity_metrics"),
        )
    )


_KEPT_SQL = """SELECT * FROM part WHERE NOT (p_partkey % 3 = 2 AND p_partkey % 2 = 0) AND abs((p_size - 25) / 20.0::DOUBLE) <= 1"""


@query("snk_extraction_rows", f"""
WITH kept AS ({_KEPT_SQL})
SELECT 'mentions_topic' AS tbl, count(*) AS n FROM (SELECT DISTINCT p_partkey, p_type FROM kept WHERE p_size % 5 > 0)
UNION ALL SELECT 'topics', count(DISTINCT p_type) FROM kept WHERE p_size % 5 > 0
UNION ALL SELECT 'concepts', count(*) FROM (SELECT p_brand FROM kept WHERE p_size % 2 = 0 UNION SELECT p_type FROM kept WHERE p_size % 2 = 0)
UNION ALL SELECT 'semantic_relation', count(*) FROM kept WHERE p_size % 2 = 0
UNION ALL SELECT 'contains_triple', count(*) FROM kept WHERE p_size % 2 = 0
UNION ALL SELECT 'references_entity', count(*) FROM kept""")
def snk_extraction_rows(spark, d):
    """Nodes and edges by table after merging: set semantics by each table's key."""
    made = graph.extraction_rows(_results(spark, d))
    counts = None
    for name in ("mentions_topic", "topics", "concepts", "semantic_relation", "contains_triple", "references_entity"):
        keys = schemas.GRAPH[name][1]
        one = made[name].select(*keys).distinct().agg(F.lit(name).alias("tbl"), F.count("*").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query("snk_graph_store", f"""
WITH kept AS ({_KEPT_SQL})
SELECT 'topic' AS kind, CAST(p_partkey AS VARCHAR) AS speech_id, p_type AS value, NULL::DOUBLE AS number FROM kept WHERE p_size % 5 > 0
UNION ALL SELECT 'relation', CAST(p_partkey AS VARCHAR), p_brand || ' MADE_AS ' || p_type, NULL FROM kept WHERE p_size % 2 = 0
UNION ALL SELECT 'entity', CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 3 = 1 THEN 'EVENT_here:' ELSE 'EVENT_{{"top' END, 0.9 FROM kept
UNION ALL SELECT 'speech', CAST(p.p_partkey AS VARCHAR), CASE WHEN k.p_partkey IS NULL THEN 'old' ELSE 'set' END, round((k.p_size - 25) / 20.0::DOUBLE, 4)
  FROM part p LEFT JOIN kept k ON k.p_partkey = p.p_partkey""")
def snk_graph_store(spark, d):
    """A graph of a speech for each part, given the same results twice, read back: edges by content, metrics on speeches."""
    store = graph.GraphStore(spark, work_dir(spark, "graph"))
    ids = V.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("speech_id"))
    store.write({"speeches": ids.select("speech_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.SPEECHES.fields[1:]))})
    for _ in range(2):
        store.upsert_extractions(_results(spark, d))
    none = F.lit(None).cast("double").alias("number")
    relation = F.concat_ws(" ", "subject", "relation", "obj").alias("value")
    state = F.when(F.col("ttr").isNull(), "old").otherwise("set").alias("value")
    return (
        store.read("mentions_topic").select(F.lit("topic").alias("kind"), "speech_id", F.col("topic").alias("value"), none)
        .unionByName(store.read("semantic_relation").select(F.lit("relation").alias("kind"), "speech_id", relation, none))
        .unionByName(store.read("references_entity").select(F.lit("entity").alias("kind"), "speech_id", F.col("entity_id").alias("value"), F.col("score").alias("number")))
        .unionByName(store.read("speeches").select(F.lit("speech").alias("kind"), "speech_id", state, F.round("sentiment_score", 4).alias("number")))
    )


@query("snk_speech_metrics", f"""
WITH kept AS ({_KEPT_SQL})
SELECT CAST(o_orderkey AS VARCHAR) AS speech_id, CASE WHEN p_partkey IS NULL THEN 0.125 ELSE round((p_size - 25) / 20.0::DOUBLE, 4) END AS sentiment_score,
  CASE WHEN p_partkey IS NULL THEN 1.0 END AS gunning_fog FROM orders LEFT JOIN kept ON p_partkey = o_orderkey""")
def snk_speech_metrics(spark, d):
    """Results set a speech's sentiment and metrics and clear those they lack; other speeches keep theirs."""
    metrics = {"sentiment_score": 0.125, "ttr": 1.0, "flesch_kincaid_grade": 1.0, "avg_sentence_length": 1.0, "gunning_fog": 1.0}
    old = V.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("speech_id"), *(F.lit(v).alias(m) for m, v in metrics.items()))
    changed = graph.with_metrics(old, _results(spark, d))
    return changed.select("speech_id", F.round("sentiment_score", 4).alias("sentiment_score"), "gunning_fog")


@query("snk_vector_upsert", """
SELECT CAST(vec_id AS VARCHAR) AS doc_id, CASE WHEN vec_id % 2 = 0 THEN 'new' ELSE 'old' END AS model_name, CAST(64 AS INTEGER) AS dim FROM embeddings""")
def snk_vector_upsert(spark, d):
    rows = V.embedded(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "vector", F.lit("old").alias("model_name"))
    new = rows.filter("CAST(doc_id AS INT) % 2 = 0").withColumns({"model_name": F.lit("new"), "seq": F.lit(2)})
    stale = rows.filter("CAST(doc_id AS INT) % 2 = 0").withColumns({"model_name": F.lit("stale"), "seq": F.lit(1)})
    merged = graph.last_writer(rows, new.unionByName(stale), ["doc_id"], ["seq"], ["vector", "model_name"])
    return merged.select("doc_id", "model_name", F.size("vector").alias("dim"))


@query("src_point_lookup", "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def src_point_lookup(spark, d):
    ids = V.read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    return V.read(spark, d, "documents").join(ids, "doc_id", "left_semi").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query("src_country_vectors", """
SELECT vec_id AS doc_id, 'P' || label AS party FROM embeddings JOIN orders ON o_orderkey = vec_id WHERE year(o_orderdate) = 1998""")
def src_country_vectors(spark, d):
    return vectors.vectors_for_country(V.embedded(spark, d), "DE", 1998).select("doc_id", "party")
