"""Explicit schemas of every record type and graph table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
MAP = T.MapType(S, S)

RAW_DOCUMENT = _struct(
    ("doc_id", S, False), ("source", S, False), ("country_code", S, False), ("language", S, False), ("text", S, False),
    ("speaker_id", S, False), ("speaker_name", S, False), ("party", S, False), ("role", S, False), ("date", T.DateType()),
    ("session_id", S, False), ("subcorpus", S), ("metadata", MAP), ("token_count", I),
)
NAMED_ENTITY = _struct(("text", S), ("label", S), ("start", I), ("end", I), ("score", D))
TRIPLE = _struct(("subject", S), ("relation", S), ("obj", S), ("subject_type", S), ("obj_type", S))
TOPIC = _struct(("label", S), ("keywords", T.ArrayType(S)))
EXTRACTION = _struct(
    ("doc_id", S, False), ("named_entities", T.ArrayType(NAMED_ENTITY)), ("topics", T.ArrayType(TOPIC)),
    ("triples", T.ArrayType(TRIPLE)), ("sentiment_score", D), ("complexity_metrics", T.MapType(S, D)),
)
SPEECHES = _struct(
    ("speech_id", S, False), ("session_id", S), ("date", T.DateType()), ("timestamp", T.TimestampType()), ("year", I),
    ("language", S), ("country_code", S), ("party", S), ("subcorpus", S), ("word_count", I), ("raw_text", S),
    ("sentiment_score", D), ("ttr", D), ("flesch_kincaid_grade", D), ("avg_sentence_length", D), ("gunning_fog", D),
    ("embedding", T.ArrayType(T.FloatType())), ("embedding_model", S),
)
POLITICIANS = _struct(
    ("politician_id", S, False), ("name", S), ("party", S), ("country_code", S), ("role", S), ("social_media_handles", MAP)
)
PARTIES = _struct(
    ("party_id", S, False), ("name", S), ("country_code", S), ("abbreviation", S), ("political_family", S)
)
SESSIONS = _struct(("session_id", S, False), ("country_code", S), ("date", T.DateType()))
TOPICS = _struct(("label", S, False), ("keywords", T.ArrayType(S)), ("language", S))
ENTITIES = _struct(("entity_id", S, False), ("text", S), ("label", S), ("canonical_text", S))
CONCEPTS = _struct(("text", S, False))
MEMBER_OF = _struct(("politician_id", S, False), ("party_id", S, False))
DELIVERED_SPEECH = _struct(("politician_id", S, False), ("speech_id", S, False), ("date", T.DateType()))
PART_OF_SESSION = _struct(("speech_id", S, False), ("session_id", S, False))
MENTIONS_TOPIC = _struct(("speech_id", S, False), ("topic", S, False))
REFERENCES_ENTITY = _struct(("speech_id", S, False), ("entity_id", S, False), ("score", D))
CONTAINS_TRIPLE = _struct(("speech_id", S, False), ("subject", S, False))
SEMANTIC_RELATION = _struct(("subject", S, False), ("obj", S, False), ("relation", S, False), ("speech_id", S, False))
SOCIAL_POST = _struct(
    ("post_id", S, False), ("platform", S), ("text", S), ("timestamp", T.TimestampType()), ("politician_id", S),
    ("language", S), ("sentiment_score", D), ("metadata", MAP),
)
EMBEDDINGS = _struct(
    ("doc_id", S, False), ("vector", T.ArrayType(T.FloatType())), ("model_name", S), ("party", S), ("country_code", S),
    ("year", I), ("language", S),
)
POST_LINES = _struct(
    ("id", S), ("text", S), ("author_id", S), ("created_at", S), ("lang", S), ("public_metrics", T.MapType(S, L)),
    ("referenced_tweets", T.ArrayType(_struct(("type", S), ("id", S)))),
)
REPLY = _struct(("topics", T.ArrayType(TOPIC)), ("triples", T.ArrayType(TRIPLE)), ("sentiment_score", D))

#: Tables of the graph with their keys: what a node or an edge is identified by.
GRAPH = {
    "speeches": (SPEECHES, ["speech_id"]),
    "politicians": (POLITICIANS, ["politician_id"]),
    "parties": (PARTIES, ["party_id"]),
    "sessions": (SESSIONS, ["session_id"]),
    "topics": (TOPICS, ["label"]),
    "entities": (ENTITIES, ["entity_id"]),
    "concepts": (CONCEPTS, ["text"]),
    "member_of": (MEMBER_OF, ["politician_id", "party_id"]),
    "delivered_speech": (DELIVERED_SPEECH, ["politician_id", "speech_id"]),
    "part_of_session": (PART_OF_SESSION, ["speech_id", "session_id"]),
    "mentions_topic": (MENTIONS_TOPIC, ["speech_id", "topic"]),
    "references_entity": (REFERENCES_ENTITY, ["speech_id", "entity_id", "score"]),
    "contains_triple": (CONTAINS_TRIPLE, ["speech_id", "subject"]),
    "semantic_relation": (SEMANTIC_RELATION, ["subject", "obj", "relation", "speech_id"]),
    "posts": (SOCIAL_POST, ["post_id"]),
    "embeddings": (EMBEDDINGS, ["doc_id"]),
}
