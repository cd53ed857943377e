"""Sharding by a Feistel permutation with cycle walking over global row numbers, native throughout.

A row's global number is its rank in the table; the permutation of [0, n) turns it into a place
``p``, and shard ``p mod k`` and slot ``p div k`` follow by arithmetic. The permutation is a Feistel
network over Z_a x Z_b with a*b just above n; a value that lands at n or beyond walks on along its
cycle. Only the a*b - n values beyond n can lie on such a walk, so the longest walk is computed
from them alone, and the expression is unrolled that many times: no row is left out of range.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table

#: Fixed by choice; part of the layout's definition.
ROUND_KEYS = (748311, 90217, 552491, 31337)
PRIME, MULTIPLIER = 2147483647, 48271
N_SHARDS = 24


def _sides(n: int) -> tuple[int, int]:
    a = max(1, isqrt(n))
    return a, max(1, -(-n // a))


def _mix(x: int, key: int) -> int:
    y = (x + key) % PRIME
    return y * y % PRIME * MULTIPLIER % PRIME


def permute_once(x: int, n: int) -> int:
    """One pass of the network on [0, a*b); the same arithmetic as ``_network``."""
    a, b = _sides(n)
    left, right = x // b, x % b
    for i, key in enumerate(ROUND_KEYS):
        if i % 2 == 0:
            left = (left + _mix(right, key)) % a
        else:
            right = (right + _mix(left, key)) % b
    return left * b + right


def permute(x: int, n: int) -> int:
    """The place of row ``x`` of ``n``: computable without the table."""
    x = permute_once(x, n)
    while x >= n:
        x = permute_once(x, n)
    return x


def longest_walk(n: int) -> int:
    """Passes that the slowest row needs. a*b - n is below sqrt(n) + 1, so this is a short loop."""
    a, b = _sides(n)
    longest = 1
    if n < 1:
        return longest
    for x in range(n, a * b):
        steps, y = 1, permute_once(x, n)
        while y >= n:
            steps, y = steps + 1, permute_once(y, n)
        longest = max(longest, steps + 1)
    return longest


def _network(x: Column, n: int) -> Column:
    a, b = _sides(n)

    def mix(v: Column, key: Column) -> Column:
        y = (v + key) % F.lit(PRIME)
        return y * y % F.lit(PRIME) * F.lit(MULTIPLIER) % F.lit(PRIME)

    def rounds(s: Column, r: Column) -> Column:
        return F.when(
            r["even"], F.struct(((s["l"] + mix(s["r"], r["key"])) % F.lit(a)).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + mix(s["l"], r["key"])) % F.lit(b)).alias("r")))

    keys = F.array(
        *(F.struct(F.lit(i % 2 == 0).alias("even"), F.lit(k).cast("long").alias("key")) for i, k in enumerate(ROUND_KEYS))
    )
    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).cast("long").alias("r"))
    return F.aggregate(keys, start, rounds, lambda s: s["l"] * F.lit(b) + s["r"])


def place(x: Column, n: int) -> Column:
    """Column form of ``permute``."""
    steps = F.array(*(F.lit(i) for i in range(longest_walk(n) - 1)))
    first = _network(x, n)
    return F.aggregate(steps, first, lambda y, _: F.when(y < F.lit(n), y).otherwise(_network(y, n)))


def row_numbers(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``row_number`` from 0 in the order of ``order`` (nulls first), and the row count.

    Rows are dealt by ranges of the order and written, so that the ranges hold still; a range's
    first number is the count of the rows in the ranges before it. Only one number per range is
    added up in one place. Rows that are equal in ``order`` are told apart by where they were read, so a
    group of them, whatever its size, is dealt to several ranges as well.
    """
    told = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = scratch(told.repartitionByRange(*order, "_tie").withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["_range"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_range int, _start long")
    w = Window.partitionBy("_range").orderBy(*order, "_tie")
    return (
        ranged.withColumn("_local", F.row_number().over(w))
        .join(F.broadcast(offsets), "_range")
        .withColumn("row_number", F.col("_start") + F.col("_local") - 1)
        .drop("_range", "_tie", "_start", "_local"),
        total,
    )


def shard(documents: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``row_number``, ``shard`` and ``slot`` of every row.

    The law is ``rows``: shard sizes differ by at most one row and slots are gapless. Rows are
    numbered by (doc_id, text_crc32, size), so repeated rows get neighbouring numbers and null ids
    come first. A null text has no bytes: size 8, checksum 0. An empty table gives no rows. Other
    columns are not used. Equal texts are not held together: that and equal counts exclude each other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    numbered, n = row_numbers(rows, ["doc_id", "text_crc32", "size"])
    return (
        numbered.withColumn("_place", place(F.col("row_number"), max(n, 1)))
        .withColumn("shard", (F.col("_place") % n_shards).cast("int"))
        .withColumn("slot", F.floor(F.col("_place") / n_shards).cast("long"))
        .drop("_place")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards by the law of equal row counts."""
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_CRC_SQL = """
bits(b, v, k) AS (SELECT b, b::BIGINT, 0 FROM range(256) r(b)
  UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS crc FROM bits WHERE k = 8),
hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
split AS (SELECT doc_id, length(h) // 2 + 8 AS size, list_transform(range(length(h) // 2), lambda i:
  ((strpos('0123456789ABCDEF', h[2*i+1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2*i+2]) - 1)::BIGINT) AS x FROM hexed),
rows AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, x),
  lambda a, y: xor(a // 256, crc[(xor(a, y) % 256) + 1])), 4294967295) AS crc FROM split, tab),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS number, count(*) OVER () AS n FROM rows),
sides AS (SELECT *, floor(sqrt(n))::BIGINT AS a FROM numbered),
"""


def _rounds_sql(value: str) -> str:
    """One pass of the network over the column ``value``, as nested selects."""
    sql = f"SELECT *, {value} // b AS l, {value} % b AS r FROM {{source}}"
    for i, key in enumerate(ROUND_KEYS):
        side, other, modulus = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        y = f"(({other} + {key}) % {PRIME})"
        mixed = f"{y} * {y} % {PRIME} * {MULTIPLIER} % {PRIME}"
        sql = f"SELECT * REPLACE (({side} + {mixed}) % {modulus} AS {side}) FROM ({sql})"
    return f"SELECT * EXCLUDE (l, r), l * b + r AS p FROM ({sql})"


OP9_SQL = f"""
WITH RECURSIVE {_CRC_SQL}
based AS (SELECT doc_id, size, crc, n, a, (n + a - 1) // a AS b, number AS v FROM sides),
walk AS ({_rounds_sql("v").format(source="based")}
  UNION ALL SELECT doc_id, size, crc, n, a, b, p AS v, q AS p FROM
    ({_rounds_sql("w").format(source="(SELECT * EXCLUDE (p), p AS w FROM walk WHERE p >= n)").replace("AS p FROM", "AS q FROM", 1).replace("SELECT * EXCLUDE (l, r)", "SELECT * EXCLUDE (l, r, w), w AS p", 1)})),
placed AS (SELECT doc_id, size, crc, p FROM walk WHERE p < n)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(p % {N_SHARDS} AS INTEGER) AS shard, p // {N_SHARDS} AS slot,
  CAST(NULL AS INTEGER) AS grown_shard FROM placed
"""
