"""URL filter: allow and block rules, and decisions that travel along redirects and canonical links.

Pages that redirect to each other (``meta`` refresh) or name each other canonical (``link
rel=canonical``) are the same resource under several addresses. Their addresses, without fragments,
form the connected components of the graph of those edges. A page that no rule fits is blocked if a
rule blocks any address of its component; an address that a rule allows stays allowed, whatever its
aliases are, and does not lift a block from them. Native DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, small_join, table
from .components import components

RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"""(?is)^<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)^<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>;]+)"""


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of rules as long, an allowing one; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def node_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^([^#]*)", 1)


def _absolute(link: Column, url: Column) -> Column:
    """``link`` as read on the page ``url``: absolute, or from the scheme, the host's root or the folder."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(url, r"(?s)^(.*?):", 1)
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, folder, link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(``a``, ``b``): the address of a page and one that it redirects to or names canonical."""
    tags = pages.filter(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)<(?:link|meta)\b[^>]*(?:canonical|refresh)")).select(
        "url", F.explode(F.regexp_extract_all("html", F.lit(_TAG), 0)).alias("tag")
    )
    link = F.coalesce(
        F.nullif(F.regexp_extract("tag", _CANONICAL, 1), F.lit("")), F.nullif(F.regexp_extract("tag", _REFRESH, 1), F.lit(""))
    )
    return (
        tags.select("url", link.alias("link"))
        .filter(F.col("link").isNotNull())
        .select(node_of(F.col("url")).alias("a"), node_of(_absolute(F.col("link"), F.col("url"))).alias("b"))
    )


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``url``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``pages``.

    ``edges`` (columns ``a``, ``b``: addresses) add to those in the pages' html; both ends may be
    addresses without a page, and rules judge them as well. A null url, or one without ``://``, has
    an empty host and path: no rule fits, and it is allowed. Null html has no links. Repeated rows
    are each judged; an empty table gives no rows; other columns are not used.
    """
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", rule).withColumn("_own", verdict)

    found = alias_edges(pages)
    if edges is not None:
        found = found.unionByName(edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")))
    found = scratch(found.distinct(), "aliases")
    if found.isEmpty():
        blocked = F.lit(False)
    else:
        nodes = components(found, "a", "b")
        _, said = fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
        bad = (
            nodes.withColumn("_said", said)
            .groupBy("component")
            .agg(F.max((F.col("_said") == "block").cast("int")).alias("_bad"))
            .filter("_bad = 1")
        )
        reached = scratch(nodes.join(bad, "component", "left_semi").select(F.col("node").alias("_node")), "blocked")
        judged = small_join(
            judged.withColumn("_node", node_of(F.col("url"))),
            reached.withColumn("_reached", F.lit(True)),
            "_node",
            "left",
            F.octet_length("_node") + 32,
        )
        blocked = F.coalesce(F.col("_reached"), F.lit(False))
    verdict = F.coalesce("_own", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the fixed rules and the aliases in the pages."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _rules_sql(host: str, path: str, column: str) -> str:
    """The longest fitting rule (or its verdict) as a CASE expression."""
    cases = ""
    for kind, text in sorted(RULES, key=lambda r: (-len(r[1]), r[0] != "allow")):
        name, slash, rest = text.partition("/")
        value = {"rule": text, "verdict": kind}[column]
        cases += f" WHEN ({host} = '{name}' OR {host} LIKE '%.{name}') AND starts_with({path}, '{slash + rest}') THEN '{value}'"
    return f"CASE{cases} END"


_HOST_SQL = "coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '" + _UPPER + "', '" + _LOWER + "'), '')"
_PATH_SQL = "coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"

OP2_SQL = f"""
WITH RECURSIVE tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
links AS (SELECT url, replace(link, '&amp;', '&') AS link FROM (SELECT url, coalesce(
    CASE WHEN regexp_matches(tag, '(?is)^<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b') THEN nullif(regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1), '') END,
    CASE WHEN regexp_matches(tag, '(?is)^<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b') THEN nullif(regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>;]+)', 1), '') END) AS link
  FROM tags) WHERE link IS NOT NULL),
edges AS (SELECT regexp_extract(url, '(?s)^([^#]*)', 1) AS a, regexp_extract(CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?):', 1) || ':' || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*/)', 1), ''), '/') || link END,
  '(?s)^([^#]*)', 1) AS b FROM links),
pairs AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
bad AS (SELECT a AS node FROM pairs WHERE {_rules_sql(_HOST_SQL.format(u="a"), _PATH_SQL.format(u="a"), "verdict")} = 'block'
  UNION SELECT b FROM bad JOIN pairs ON a = node),
judged AS (SELECT page_id, url, {_HOST_SQL.format(u="url")} AS host, {_PATH_SQL.format(u="url")} AS path FROM pages)
SELECT page_id, host, path, {_rules_sql("host", "path", "rule")} AS rule, coalesce({_rules_sql("host", "path", "verdict")},
  CASE WHEN regexp_extract(url, '(?s)^([^#]*)', 1) IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""
