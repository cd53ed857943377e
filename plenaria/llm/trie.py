"""Prefix trie of conversations, with subtree sums by heavy-path decomposition.

A node is a sequence of first turns. Its key is its depth and the sum, by digit group, of SHA-256 digests of its turns
with their places, so keys of a conversation of any length are running sums, and equal conversations meet by an
aggregate. Only one conversation of each sequence is spelled out in nodes; the others count as its weight.

Each node's heavy child is the one of most conversations (of equals, the one of least member). Heavy children continue
their parent's path, light ones begin a path. A light child has at most half of its parent's conversations, so no node
is below more than log2(conversations) light ones. Sums of whole paths are attached to the parents of their tops, from
the deepest paths on, one round for each number of light nodes above; then one suffix sum along each path gives the
sums of all subtrees.

Sums along a conversation or a path are taken in blocks of ``BLOCK`` places and then over blocks, so one that holds a third
of all turns is spread over tasks. Members that end in a node are written as chunks of text by ranges of their ids, and a
digest reads its node's chunks in order: a group of copies of any size is streamed, never gathered.

Defined results. Turns are ordered by turn (null first), then role and text, null role or text being empty; repeated rows
are turns of their own. Rows without conv_id belong to no conversation and are left out. Whole texts count. No
conversations: no nodes, not even the root. Other columns are left out. Turns of one conversation that share a block of
turn numbers are sorted in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, spread_join, table

#: Places of a conversation or path that are summed in one task.
BLOCK = 4096
#: The conversation that a conversation's first turns come from is the first of so many; at most HEAD - 1 turns do.
FAMILY, HEAD = 20, 4
#: Ids in a chunk of text.
CHUNK_IDS = 8192
#: Groups of eight hex digits of a digest that are summed: 160 bits.
PIECES = 5

_SUMS = [f"s{i}" for i in range(PIECES)]


def running(rows: DataFrame, keys: list[str], place: str, sums: dict[str, Column], down: bool = False, most: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with each of ``sums`` added up (of ``most``: its maximum) over the rows of the same ``keys`` up to each
    row's ``place``, a whole number of its own; with ``down`` from its place on. By blocks of places first, so that
    no task gets all rows of a key."""
    most = most or {}
    blocked = rows.withColumn("_block", F.floor(F.col(place) / BLOCK))
    by = F.desc if down else F.asc
    here = Window.partitionBy(*keys, "_block").orderBy(by(place)).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumns({n: F.sum(c).over(here) for n, c in sums.items()} | {n: F.max(c).over(here) for n, c in most.items()})
    whole = blocked.groupBy(*keys, "_block").agg(*(F.sum(c).alias(n) for n, c in sums.items()), *(F.max(c).alias(n) for n, c in most.items()))
    before = Window.partitionBy(*keys).orderBy(by("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(
        *keys, "_block", F.row_number().over(Window.partitionBy(*keys).orderBy(by("_block"))).alias("_nth"),
        *(F.sum(n).over(before).alias(f"_{n}") for n in sums), *(F.max(n).over(before).alias(f"_{n}") for n in most),
    ).filter("_nth > 1").drop("_nth")
    met = local.join(carried, [*keys, "_block"], "left")
    # The greatest of a carried and a local value; nulls are skipped.
    after = {n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in sums} | {n: F.greatest(n, f"_{n}") for n in most}
    return met.withColumns(after).drop("_block", *(f"_{n}" for n in (*sums, *most)))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, place from 1, said, words) of all conversations, in order; by blocks of turn numbers. said: a digest of
    role and text, which aren't needed after this."""
    rows = turns.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("_part", F.floor(F.col("turn") / BLOCK))  # null first, as turns are
    counts = rows.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.sum("c").over(before)).filter("_start IS NOT NULL").select("conv_id", F.col("_part"), "_start")
    here = Window.partitionBy("conv_id", "_part").orderBy("turn", "role", "text")
    local = rows.withColumn("_nth", F.row_number().over(here)).join(starts, ["conv_id", "_part"], "left")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    said = F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).alias("said")
    return local.select("conv_id", (F.col("_nth") + F.coalesce("_start", F.lit(0))).alias("place"), said, words)


def _taken(conv: Column) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % HEAD


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, place, said, words): each conversation's first turns are those of the first of its family, if that
    has them, and its own ones follow. ``convs``: (conv_id, n) of all of them, n being how many turns they have."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEAD)).withColumnRenamed("conv_id", "_base")
    known = convs.withColumns({"_base": base, "h": _taken(F.col("conv_id"))})
    first = known.filter("h > 0").join(heads, "_base").filter("place <= h").select("conv_id", "place", "said", "words")
    short = known.join(convs.select(F.col("conv_id").alias("_base"), F.col("n").alias("_has")), "_base", "left")
    # Where the family's first has fewer turns than asked for, one's own turns move up.
    short = short.select("conv_id", "n", (F.col("h") - F.least(F.col("h"), F.coalesce("_has", F.lit(0)))).alias("lacks")).filter("lacks > 0")
    total = convs.agg(F.sum("n")).first()[0] or 0
    own = spread_join(turns.filter(F.col("place") > _taken(F.col("conv_id"))), short, "conv_id", total, how="left")
    own = own.select("conv_id", (F.col("place") - F.coalesce("lacks", F.lit(0))).alias("place"), "said", "words")
    return first.unionByName(own)


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids that follow each other under one key, as text."""
    key, ids = None, []

    def chunk() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], ["key", "first", "ids"])

    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (k != key or len(ids) == CHUNK_IDS):
                yield chunk()
                ids = []
            key = k
            ids.append(c)
    if ids:
        yield chunk()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's chunks, which follow each other in order."""
    key, digest, found = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if digest is not None and k == key:
                digest.update(b"," + ids.encode())
                continue
            if digest is not None:
                found.append((key, digest.hexdigest()))
            key, digest = k, hashlib.sha256(ids.encode())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["key", "ends_sha256"])
            found = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256) of ``members`` (key, conv_id): their ids in order, joined by commas."""
    ranged = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = ranged.mapInArrow(_id_chunks, "key string, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key string, ends_sha256 string")


def _path_sums(paths: DataFrame) -> DataFrame:
    """(at, leaves, saved): sums over all paths that hang from a node, with all that hangs from them. ``paths``: path,
    its parent's key (at) and path (above), depth in light nodes (level), its own leaves and saved."""
    deepest = paths.agg(F.max("level")).first()[0] or 0
    done = None
    for level in range(deepest, 0, -1):
        at_level = paths.filter(F.col("level") == level)
        if done is not None:
            below = done.filter(F.col("level") == level + 1).groupBy(F.col("above").alias("path")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
            at_level = at_level.join(below, "path", "left").withColumns(
                {"leaves": F.col("leaves") + F.coalesce("_l", F.lit(0)), "saved": F.col("saved") + F.coalesce("_s", F.lit(0))}
            )
        here = scratch(at_level.select("at", "above", "level", "leaves", "saved"), "paths")
        done = here if done is None else done.unionByName(here)
    if done is None:
        done = paths.limit(0)  # the tree is one path
    return done.groupBy("at").agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, turn, role, text), rebuilt by families."""
    spark = conversations.sparkSession
    turns = scratch(numbered(conversations), "turns")
    convs = scratch(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "convs")
    digest = F.sha2(F.concat(F.encode(F.concat(F.col("place").cast("string"), F.lit(":")), "UTF-8"), "said"), 256)
    pieces = {s: F.conv(F.substring(F.col("_d"), 8 * i + 1, 8), 16, 10).cast("long") for i, s in enumerate(_SUMS)}
    marked = rebuilt(turns, convs).select("conv_id", "place", "words", digest.alias("_d")).withColumns(pieces).drop("_d")
    marked = scratch(marked, "digests")

    def key(depth: Column) -> Column:
        return F.concat_ws(":", depth, *(F.col(s) for s in _SUMS))

    # Conversations by whole sequence: its key, and one that is spelled out.
    whole = marked.groupBy("conv_id").agg(F.max("place").alias("d"), *(F.sum(s).alias(s) for s in _SUMS))
    zero = {s: F.coalesce(s, F.lit(0)) for s in ("d", *_SUMS)}
    members = scratch(convs.select("conv_id").join(whole, "conv_id", "left").withColumns(zero).select("conv_id", key(F.col("d")).alias("key")), "members")
    one_each = members.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("w"))
    one_each = scratch(one_each.select("conv_id", "w"), "sequences")

    # Nodes on the way of each sequence, the root among them.
    spelled = marked.join(one_each.select("conv_id"), "conv_id")
    spelled = running(spelled, ["conv_id"], "place", {s: F.col(s) for s in _SUMS})
    root = one_each.select("conv_id", F.lit(0).alias("place"), F.lit(0).cast("long").alias("words"), *(F.lit(0).cast("long").alias(s) for s in _SUMS))
    chain = spelled.unionByName(root).join(one_each, "conv_id").select("conv_id", F.col("place").cast("long").alias("depth"), "words", "w", key(F.col("place")).alias("key"))
    chain = scratch(chain, "chain")
    nodes = chain.groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("w").alias("n_convs"), F.max("words").alias("words"), F.count(F.lit(1)).alias("n")
    )
    nodes = scratch(nodes, "nodes")

    # Each node's parent is the one before it on the way of its least member.
    above = chain.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"))
    linked = scratch(nodes.join(above, ["conv_id", "depth"], "left"), "linked")
    order = F.struct("n_convs", (-F.col("conv_id")).alias("_least"))
    children = linked.filter("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.max_by("key", order).alias("heavy"))
    children = scratch(children, "children")
    light = linked.join(children.select(F.col("heavy").alias("key"), F.lit(False).alias("light")), "key", "left")
    light = light.withColumn("light", F.coalesce("light", F.col("parent").isNotNull()))  # the root begins a path as well

    # Tops of paths, and how many light nodes there are down to each node, along the chains.
    total = chain.count()
    on_way = spread_join(chain.select("conv_id", "depth", "key"), light.select("key", F.col("conv_id").alias("least"), "light", "n"), "key", total)
    begins = F.when(F.col("light") | (F.col("depth") == 0), F.struct("depth", "key"))
    walked = running(on_way, ["conv_id"], "depth", {"level": F.col("light").cast("long")}, most={"top": begins})
    walked = walked.filter("conv_id = least").select("key", "level", F.col("top.key").alias("path"))

    facts = linked.join(children.select(F.col("parent").alias("key"), "n_children"), "key", "left").join(walked, "key")
    facts = facts.withColumns(
        {
            "n_children": F.coalesce("n_children", F.lit(0)),
            "leaves": F.col("n_children").isNull().cast("long"),
            "saved": (F.col("n_convs") - 1) * F.col("words"),
        }
    )
    facts = scratch(facts.drop("words", "n"), "facts")

    # Sums of whole paths, attached to the parents of their tops.
    own = facts.groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("n"))
    tops = facts.filter("key = path").select("path", "level", F.col("parent").alias("at"))
    parents = facts.select(F.col("key").alias("at"), F.col("path").alias("above"), F.col("n_children").alias("n"))
    below = tops.filter("at IS NOT NULL")
    sized = spread_join(below, parents, "at", below.count())
    paths = scratch(own.drop("n").join(sized, "path"), "tops")
    hung = _path_sums(paths).withColumnRenamed("at", "key")

    # Suffix sums along the paths.
    placed = facts.join(hung, "key", "left").withColumns({"_l": F.coalesce("_l", F.lit(0)), "_s": F.coalesce("_s", F.lit(0))})
    summed = running(placed, ["path"], "depth", {"n_leaves": F.col("leaves") + F.col("_l"), "saved_tokens": F.col("saved") + F.col("_s")}, down=True)

    # Parents' ids: a parent of many children is sent to where they are.
    named = linked.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")).join(children.select("parent", F.col("n_children").alias("n")), "parent")
    full = spread_join(summed, named, "parent", total, how="left").join(ends(members), "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of all conversations."""
    return trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(said ORDER BY place) AS turns FROM t GROUP BY conv_id),
crc AS (SELECT k, list_reduce(range(0, 8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, k) AS v FROM range(0, 256) x(k)),
steps AS (SELECT list(v ORDER BY k) AS crcs FROM crc),
h AS (SELECT conv_id, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, b: xor(a // 256, crcs[xor(a, b) % 256 + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h FROM own, steps),
built AS (SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], o.turns[h.h + 1:]) AS turns
  FROM own o JOIN h USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
chain AS (SELECT conv_id, d AS depth, turns[1:d] AS seq, len(turns) AS n FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM built)),
nodes AS (SELECT depth, seq, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ids,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(seq[-1].t, '[^\x20\x09-\x0D]+')) END AS words FROM chain GROUP BY depth, seq),
kids AS (SELECT seq[1:depth - 1] AS seq, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, p.conv_id AS parent_conv_id FROM nodes n
  LEFT JOIN kids k ON k.depth = n.depth AND k.seq = n.seq LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.seq = n.seq[1:n.depth - 1]),
subtree AS (SELECT seq[1:a] AS seq, a AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM full_nodes) GROUP BY ALL)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM full_nodes n JOIN subtree s ON s.depth = n.depth AND s.seq = n.seq
"""
