"""Linguistic complexity of texts as native expressions.

Flesch reading ease, Flesch-Kincaid grade and Gunning fog follow the published formulas. Their
syllables are groups of vowels (at least one a word), and their sentences are the pieces between
full stops, exclamation and question marks with more than two words (at least one a text): an
approximation meant for trends. Without a language one rule serves all; with one, syllables follow a rule of that language
and reading ease has the constants that were published for it.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcounts
from .scalar import language_key, rounded, words

TOKEN = r"(?U)\b[a-zA-ZÀ-ÿ]{2,}\b"
VOWELS = "[aeiouyà-æè-ïò-öø-ýÿœ]+"
BASIC = ("ttr", "cttr", "avg_sentence_length", "avg_word_length")
METRICS = (*BASIC, "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "lexicon_count", "sentence_count")


#: Base, weight of sentence length and weight of syllables a word of the reading ease of each language key
#: (Amstad for German, Fernandez Huerta for Spanish, Kandel and Moles for French, Vacca for Italian, Douma for Dutch).
READING_EASE = {
    "en_US": (206.835, 1.015, 84.6),
    "de": (180.0, 1.0, 58.5),
    "es": (206.84, 1.02, 60.0),
    "fr": (207.0, 1.015, 73.6),
    "it": (217.0, 1.3, 60.0),
    "nl": (206.835, 0.93, 77.0),
}
#: Syllables from which a word is hard, where it isn't 3.
HARD = {"pl": 4}
#: By language key: what is cut from the end of a word first, for it isn't spoken, and what is one syllable in the rest.
#: English and French drop a last e that a vowel came before; German tells diphthongs from vowels in hiatus; in Spanish,
#: Italian and Portuguese each strong or accented vowel is a syllable, with the weak ones beside it.
SILENT = {"en_US": "([aeiouy].*[^aeiouyl])e$", "fr": "(?:([aeiouyà-ÿœ].*[qg])u|([aeiouyà-ÿœ].*[^aeiouyà-ÿœ]))es?$"}
_STRONG = "[iuüy]*[aeoáéíóúàèìòùâêôãõ][iuy]*|[iuüy]+"
NUCLEI = {"de": "ie|ei|ai|au|eu|äu|ey|ay|oi|aa|ee|oo|[aeiouyäöüéèà]", "es": _STRONG, "it": _STRONG, "pt": _STRONG}


def syllables(word: Column, language: Column | None = None) -> Column:
    """Syllables of a lower-case word, at least one. language: a key as ``language_key`` gives."""
    def counted(w: Column, pattern: str) -> Column:
        return F.greatest(F.size(F.regexp_extract_all(w, F.lit(pattern), 0)), F.lit(1))

    found = counted(word, VOWELS)
    if language is None:
        return found
    for key in (*SILENT, *NUCLEI):
        spoken = F.regexp_replace(word, SILENT[key], "$1$2" if key == "fr" else "$1") if key in SILENT else word
        found = F.when(language == key, counted(spoken, NUCLEI.get(key, VOWELS))).otherwise(found)
    return found


def _constant(language: Column | None, place: int) -> Column:
    default = F.lit(READING_EASE["en_US"][place])
    if language is None:
        return default
    table = F.create_map(*(F.lit(x) for k, v in READING_EASE.items() for x in (k, v[place])))
    return F.coalesce(F.try_element_at(table, language), default)


def tokens(text: Column) -> Column:
    """Lower-cased words of two or more letters up to U+00FF, whole words only."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), F.lower)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def with_complexity(
    df: DataFrame, text: str = "text", basic: bool = False, metrics: Sequence[str] | None = None, language: Column | None = None
) -> DataFrame:
    """``df`` with a column for each metric; null where the text is null or blank.

    language: a tag of each row's language; its rules for syllables and reading ease are used, or those of one without
    rules of its own.

    basic: only the four metrics that need no syllables. metrics: only those named. Existing columns of
    those names are replaced. The metrics come from one generated row, so that a filter on one of them is
    not pushed below it and does not evaluate it again.
    """
    names = tuple(metrics) if metrics is not None else BASIC if basic else METRICS
    if language is None:
        rest = [c for c in df.columns if c not in names]
        made = df.withColumn("_counts", _counted(_said(text)))
        return made.select(*rest, F.inline(F.array(F.struct(*(c.alias(n) for n, c in from_counts(F.col("_counts")).items() if n in names)))))
    t = _said(text)
    lexicon = F.filter(F.transform(words(t), lambda w: F.regexp_replace(w, r"(?U)[^\w\s']", "")), lambda w: w != "")
    pieces = F.filter(F.split(t, "[.!?]+"), lambda p: p.rlike(r"(?U)\S"))
    parts = {"_tokens": tokens(t), "_sizes": F.transform(pieces, lambda p: F.size(words(p))), "_lexicon": lexicon}
    parts["_language"] = language_key(F.coalesce(language, F.lit("")))
    key = F.col("_language")
    made = df.withColumns(parts).withColumn("_syllables", F.transform("_lexicon", lambda w: syllables(F.lower(w), key)))
    least = F.lit(3)
    for name, n in HARD.items():
        least = F.when(key == name, n).otherwise(least)
    columns = _formulas(
        {
            "tokens": F.size("_tokens"), "distinct": F.size(F.array_distinct("_tokens")), "token_chars": _total(F.transform("_tokens", F.length)),
            "sentences": F.size("_sizes"), "sentence_words": _total(F.col("_sizes")), "long_sentences": F.size(F.filter("_sizes", lambda k: k > 2)),
            "lexicon": F.size("_lexicon"), "syllables": _total(F.col("_syllables")), "hard": F.size(F.filter("_syllables", lambda k: k >= least)),
        },
        F.col("_tokens").isNotNull(), key,
    )
    rest = [c for c in df.columns if c not in names]
    return made.select(*rest, F.inline(F.array(F.struct(*(columns[c].alias(c) for c in names)))))


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in textcounts.COUNTS]))
def _counted(texts: pa.Array) -> pa.Array:
    return textcounts.counted(texts)


def _said(text: str) -> Column:
    """The text, null if it is blank."""
    return F.when(F.coalesce(F.col(text), F.lit("")).rlike(r"(?U)\S"), F.col(text))


def from_counts(counts: Column) -> dict[str, Column]:
    """The metrics by name, of a struct of ``textcounts.COUNTS``; null where it is."""
    return _formulas({c: counts[c] for c in textcounts.COUNTS}, counts.isNotNull())


def _formulas(counts: dict[str, Column], there: Column, key: Column | None = None) -> dict[str, Column]:
    def where(some: Column, value: Column, digits: int) -> Column:
        return F.when(some > 0, rounded(value, digits)).otherwise(F.when(there, F.lit(0.0)))

    n, sentences, lex = counts["tokens"], counts["sentences"], counts["lexicon"]
    sent = F.greatest(counts["long_sentences"], F.lit(1))
    length, spoken, hard = F.try_divide(lex, sent), F.try_divide(counts["syllables"], lex), F.try_divide(counts["hard"], lex)
    return {
        "ttr": where(n, F.try_divide(counts["distinct"], n), 4),
        "cttr": where(n, F.try_divide(counts["distinct"], F.sqrt(2.0 * n)), 4),
        "avg_sentence_length": where(sentences, F.try_divide(counts["sentence_words"], sentences), 2),
        "avg_word_length": where(n, F.try_divide(counts["token_chars"], n), 2),
        "flesch_reading_ease": where(lex, _constant(key, 0) - _constant(key, 1) * length - _constant(key, 2) * spoken, 2),
        "flesch_kincaid_grade": where(lex, 0.39 * length + 11.8 * spoken - 15.59, 2),
        "gunning_fog": where(lex, 0.4 * (length + 100 * hard), 2),
        "lexicon_count": F.when(there, lex.cast("double")),
        "sentence_count": F.when(there, sent.cast("double")),
    }


def metrics_map(df: DataFrame, text: str = "text", name: str = "complexity_metrics", language: str | None = None) -> DataFrame:
    """``df`` with the metrics as one map, empty for a blank text. language: the column with each row's language tag."""
    made = with_complexity(df.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), "_text", language=language and F.col(f"_row.{language}"))
    return made.select("_row.*", as_map({m: F.col(m) for m in METRICS}).alias(name))


def as_map(metrics: dict[str, Column]) -> Column:
    """The metrics as one map, empty where they are null."""
    pairs = [x for m in METRICS for x in (F.lit(m), metrics[m])]
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return F.when(metrics["ttr"].isNull(), empty).otherwise(F.create_map(*pairs))
