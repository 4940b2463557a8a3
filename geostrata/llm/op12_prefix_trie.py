"""Prefix trie of conversations with rolled-up counts (operator 12).

A node is a distinct sequence of first turns. Its key is the sum, in four lanes of 32 bits,
of digests of (depth, role, text) over the sequence, so keys come from running sums over
ranges of turns, and a conversation of any length is never one task.

1. Turns are numbered within their conversation, conversations are rebuilt with the head of
   their base, and running sums give each turn the key of its node and of its parent.
2. Turns are grouped to nodes by partial aggregates: members, smallest member, children.
3. Pointer jumping rolls leaves and savings up. In a round each live node adds what it holds
   to the node its pointer names and then points as far again; a node whose pointer leaves
   the tree is live no more. Rounds grow with the logarithm of the depth. What a node gets
   is summed partially, and pointers to nodes with very many others are looked up by a
   broadcast of fewer than a thousand rows.
4. Conversations that end in a node are hashed in runs of ids, not as one list.

Defined results: null role or text counts as empty, null turns come first, equal turns go by
role, then text; repeated rows are turns of their own; rows without conv_id are left out; a
conversation whose base is absent has no head; an empty table has no root and no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WORD, column_or_null, crc32_of, crc32_sql, joined_sha256, running_sums, spread_join, table, through_files

FAMILY = 20
HEADS = 4
LANES = 4
#: Ids in one piece of a node's list of ends, about.
RANGE_IDS = 50_000


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1), ``digest`` of role and text, ``words``."""
    text = lambda c: F.coalesce(column_or_null(conversations, c, "string"), F.lit("")).alias(c)
    rows = conversations.select(column_or_null(conversations, "conv_id", "long"), column_or_null(conversations, "turn", "long"), text("role"), text("text"), F.lit(1).alias("one"))
    placed = running_sums(rows.where("conv_id is not null"), ["conv_id"], [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], {"before": "one"}, "trie-turns")
    digest = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), 1, 32)
    return through_files(placed.select("conv_id", (F.col("before") + 1).alias("pos"), digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "trie-digests")


def rebuild(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations ``conv_id, n`` (turns after rebuilding) and their turns ``conv_id, depth, digest, words``.

    Conversation c takes the first h turns of c - c % family and then its own after the first h, h = crc32(c) % heads.
    """
    counts = through_files(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "trie-counts")
    h = (crc32_of(F.col("conv_id").cast("string")) % heads).alias("h")
    convs = counts.select("conv_id", "own", h, (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    convs = convs.join(counts.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns")), "base", "left").withColumn("take", F.least("h", F.coalesce("base_turns", F.lit(0))))
    convs = through_files(convs.select("conv_id", "own", "h", "base", "take"), "trie-convs")
    first = turns.where((F.col("pos") < heads) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "digest", "words")
    head = convs.join(first, "base").where("depth <= take").select("conv_id", "depth", "digest", "words")
    own = spread_join(turns, convs.select("conv_id", "own", "h", "take"), ["conv_id"], "own")
    rest = own.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("take")).alias("depth"), "digest", "words")
    return convs.select("conv_id", (F.col("take") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), through_files(head.unionByName(rest), "trie-rebuilt")


def keyed(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, node, parent, words``: keys of prefixes; the root's key is empty."""
    full = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "digest").cast("binary"), 256)
    lane = lambda k: F.conv(F.substring(full, 8 * k + 1, 8), 16, 10).cast("long").alias(f"a{k}")
    lanes = rows.select("conv_id", "depth", "words", *map(lane, range(LANES)))
    summed = running_sums(lanes, ["conv_id"], [F.col("depth")], {f"p{k}": f"a{k}" for k in range(LANES)}, "trie-chain")
    key = lambda sums: F.concat(*(F.lpad(F.lower(F.hex(s.bitwiseAND(0xFFFFFFFF))), 8, "0") for s in sums))
    parent: Column = F.when(F.col("depth") == 1, "").otherwise(key([F.col(f"p{k}") for k in range(LANES)]))
    return through_files(summed.select("conv_id", "depth", key([F.col(f"p{k}") + F.col(f"a{k}") for k in range(LANES)]).alias("node"), parent.alias("parent"), "words"), "trie-rows")


def roll_up(nodes: DataFrame, deepest: int, values: tuple[str, ...]) -> DataFrame:
    """``node`` and, for each value, its sum over the node's subtree, from ``nodes(node, parent, depth, *values)`` of trees up to ``deepest`` edges deep."""
    live = nodes.where("parent is not null").select("node", F.col("parent").alias("ptr"), "depth", *values)
    found, reach = nodes.select("node", *values), 1
    while reach <= deepest:
        up = through_files(live.groupBy("ptr").agg(*(F.sum(v).alias(v) for v in values), F.count("*").alias("n")), "trie-up")
        found, reach = found.unionByName(up.select(F.col("ptr").alias("node"), *values)), 2 * reach
        if reach <= deepest:
            further = through_files(up.select("ptr", "n").join(live.select(F.col("node").alias("ptr"), F.col("ptr").alias("next")), "ptr"), "trie-further")
            got = up.select(F.col("ptr").alias("node"), *(F.col(v).alias(f"__{v}") for v in values))
            deep = live.where(F.col("depth") >= reach)  # a pointer of the others names a root or less
            grown = deep.join(got, "node", "left").select("node", "ptr", "depth", *((F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values))
            moved = spread_join(grown, further, ["ptr"], "n")
            live = through_files(moved.select("node", F.col("next").alias("ptr"), "depth", *values), "trie-live")
    return found.groupBy("node").agg(*(F.sum(v).alias(v) for v in values))


def ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of nodes in which conversations end."""
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "node"))["node"].alias("node"))
    all_ = through_files(convs.where("n = 0").select("conv_id", F.lit("").alias("node")).unionByName(last), "trie-ends")
    dealt = all_.repartitionByRange(max(1, -(-all_.count() // RANGE_IDS)), "node", "conv_id").withColumn("part", F.spark_partition_id())
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: F.concat(F.lit(","), c.cast("string")))
    pieces = through_files(dealt.groupBy("node", "part").agg(F.array_join(ids, "").alias("piece")), "trie-pieces")
    counted = pieces.join(pieces.groupBy("node").agg(F.count("*").alias("n")), "node")
    return joined_sha256(counted, "node", "part", "piece", "n").withColumnRenamed("sha256", "ends_sha256")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """One row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node, parent``."""
    convs, rebuilt = rebuild(numbered_turns(conversations), family, heads)
    rows = keyed(rebuilt)
    grouped = rows.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("words").alias("words"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit("").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "n_convs", "conv_id")
    nodes = through_files(root.unionByName(grouped), "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumns({"saved_tokens": (F.col("n_convs") - 1) * F.col("words"), "n_leaves": (F.col("n_children") == 0).cast("long")})
    nodes = through_files(nodes, "trie-base")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = roll_up(nodes, deepest, ("n_leaves", "saved_tokens"))
    above = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = nodes.where("parent is not null").select("node", "parent")
    named = spread_join(below, above, ["parent"], "n_children").select("node", "parent_conv_id")
    out = nodes.drop("n_leaves", "saved_tokens").join(sums, "node").join(named, "node", "left").join(ends(rows, convs), "node", "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"), "node", "parent")


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


SQL = f"""WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM t GROUP BY conv_id),
j AS (
  SELECT c.conv_id, 0 AS side, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h
), d AS (
  SELECT conv_id, row_number() OVER w AS depth, list({{'r': role, 't': text}}) OVER (w ROWS UNBOUNDED PRECEDING) AS seq, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM j WINDOW w AS (PARTITION BY conv_id ORDER BY side, pos)
), r AS (
  SELECT conv_id, depth, sha256(seq::JSON::VARCHAR) AS node, words FROM d UNION ALL SELECT conv_id, 0, 'root', 0 FROM c
), p AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM r),
n AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM p GROUP BY node
), k AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.node),
s AS (
  SELECT a.node, sum((m.n_children = 0)::INT)::BIGINT AS n_leaves, sum(m.saved)::BIGINT AS saved_tokens
  FROM (SELECT DISTINCT a.node, b.node AS below FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth) a JOIN m ON m.node = a.below GROUP BY a.node
)
SELECT m.conv_id, m.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN s USING (node) LEFT JOIN n q ON q.node = m.parent"""
