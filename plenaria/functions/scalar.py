"""Scalar and aggregate expressions, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name space of URL-derived UUIDs (RFC 9562).
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
#: Language keys of the complexity formulas, by the first part of a language tag; others are en_US.
LANGUAGES = {
    "de": "de", "fr": "fr", "es": "es", "it": "it", "nl": "nl", "pl": "pl", "pt": "pt", "en": "en_US", "fi": "fi",
    "et": "et", "lv": "lv", "lt": "lt",
}


def stdev0(x: Column) -> Column:
    """Sample deviation, 0.0 for a single value, null for none."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(x: Column | str, digits: int) -> Column:
    """Rounded half up, where a sum's order of addition must not decide a tie."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x + F.signum(x) * 1e-9, digits)


def words(text: Column) -> Column:
    """Runs of anything but (Unicode) white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def party_id(country: Column, party: Column) -> Column:
    return F.concat(country, F.lit("_"), F.replace(party, F.lit(" "), F.lit("_")))


def entity_id(label: Column, text: Column) -> Column:
    return F.concat(label, F.lit("_"), F.replace(F.lower(text), F.lit(" "), F.lit("_")))


def relation_name(relation: Column) -> Column:
    return F.replace(F.upper(F.coalesce(relation, F.lit("RELATED_TO"))), F.lit(" "), F.lit("_"))


def without_hashes(ref: Column) -> Column:
    return F.regexp_replace(ref, "^#+", "")


def subcorpus(target: Column) -> Column:
    """Last dotted part of a category reference, upper case; null if empty or absent."""
    return F.when(F.length(target) > 0, F.upper(F.element_at(F.split(target, r"\."), -1)))


def language_key(tag: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.element_at(table, F.lower(F.split(tag, "-")[0])), F.lit("en_US"))


def flexible_date(s: Column) -> Column:
    """yyyy-mm-dd, yyyymmdd, yyyy-mm or yyyy (first day), or a yyyy-mm-dd anywhere in the string; else null."""
    t = F.trim(s)
    inside = F.nullif(F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.coalesce(
        F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(t, "yyyy-M-d")),
        F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd")),
        F.when(t.rlike(r"^\d{4}-\d{1,2}$"), F.try_to_date(t, "yyyy-M")),
        F.when(t.rlike(r"^\d{4}$"), F.try_to_date(F.concat(t, F.lit("-01-01")), "yyyy-MM-dd")),
        F.try_to_date(inside, "yyyy-MM-dd"),
    )


def uuid5_url(name: Column) -> Column:
    """The version-5 UUID of ``name`` in the URL name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)
