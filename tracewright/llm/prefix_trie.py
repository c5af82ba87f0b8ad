"""The trie of conversations' beginnings, with totals of subtrees by leaf-peeling messages.

A node is a distinct sequence of first turns. It is named by a digest of sums of
its turns' digests, each salted by its position: sums run in windows, so no
conversation is walked turn by turn and a very long one is cut into segments.

Subtree totals are found by peeling. Every node belongs to the path of the
longest conversation through it (of equally long ones the smallest id): such
paths part the trie into runs that each end in a leaf, and a run without
branches is one message, however long it is. A path counts the children beside
it that have not reported; once none is left it sends its totals to the node that it
hangs on, until only the root's path finishes. A path that hangs k paths below
the root's has k longer ones above it, so rounds number at most about the square root
of twice the number of nodes, and few in practice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import running
from ._shared import cut, table

#: Turns of one conversation, or depths of one path, that a segment of a scan spans; conversation ids that a piece of a list of ids spans.
SEGMENT, PIECE = 1024, 4096
#: 32-bit words of a turn's digest that are summed up to name a node.
WORDS = 5


def numbered(conversations: DataFrame) -> DataFrame:
    """(c, p, digest, size): turns by place p from 0, in order of turn (null first); equal turns in order of their digests. Rows without conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("size"))
    segment = F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62)))
    return running(turns, ["c"], [F.col("turn").asc_nulls_first(), "digest"], segment, sums={"p": F.lit(1).cast("long")}, inclusive=False).drop("turn")


def shared_starts(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, total) and their rebuilt turns (c, depth, digest, size, total).

    The first h = crc32(c) mod `most` turns are those of conversation c - c % every (as many as there are); then come c's own after its first h.
    """
    lengths = turns.groupBy("c").agg(F.count("*").alias("n"))
    givers = lengths.where(F.col("c") % every == 0).select(F.col("c").alias("giver"), F.col("n").alias("g_n"))
    asked = lengths.withColumn("h", F.crc32(F.col("c").cast("string")) % most).withColumn("giver", F.col("c") - F.col("c") % every).join(givers, "giver", "left")
    taken = F.least("h", F.coalesce("g_n", F.lit(0)))
    plans = cut(asked.select("c", "giver", "h", taken.alias("t"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")))
    first = turns.where((F.col("c") % every == 0) & (F.col("p") < most - 1)).withColumnRenamed("c", "g")
    given = plans.join(first, (F.col("giver") == F.col("g")) & (F.col("p") < F.col("t"))).select("c", (F.col("p") + 1).alias("depth"), "digest", "size", "total")
    own = turns.join(plans, "c").where("p >= h").select("c", (F.col("t") + F.col("p") - F.col("h") + 1).alias("depth"), "digest", "size", "total")
    return plans.select("c", "total"), given.unionByName(own)


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]), 256))


def memberships(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """(c, depth, node, parent, size, total): a row for each conversation (c, total) and node that it starts with, the root included."""
    salted = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("digest")), 256)
    words = {f"w{k}": F.conv(F.substring("salted", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(WORDS)}
    marked = turns.withColumn("salted", salted).withColumns(words).drop("salted", "digest")
    summed = running(marked, ["c"], ["depth"], F.floor(F.col("depth") / SEGMENT), sums={f"s{k}": F.col(f"w{k}") for k in range(WORDS)})
    node = _name(F.col("depth"), [F.col(f"s{k}") for k in range(WORDS)])
    parent = _name(F.col("depth") - 1, [F.col(f"s{k}") - F.col(f"w{k}") for k in range(WORDS)])
    below = summed.select("c", "depth", node.alias("node"), parent.alias("parent"), "size", "total")
    zero = F.lit(0).cast("long")
    root = conversations.select("c", zero.alias("depth"), _name(zero, [zero] * WORDS).alias("node"), F.lit(None).cast("binary").alias("parent"), zero.alias("size"), "total")
    return root.unionByName(below)


def path_totals(paths: DataFrame) -> DataFrame:
    """(path, hangs_on, leaves, saved) of whole subtrees, from paths' own (path, above, hangs_on, leaves, saved); above is null for the root's path."""
    waiting = paths.where("above is not null").groupBy("above").agg(F.count("*").alias("remaining"))
    counted = paths.join(waiting.withColumnRenamed("above", "path"), "path", "left").na.fill(0, ["remaining"])
    open_, done = cut(counted), []
    while True:
        ready, rest = open_.where("remaining = 0"), open_.where("remaining > 0")
        done.append(ready.select("path", "hangs_on", "leaves", "saved"))
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        sent = ready.groupBy(F.col("above").alias("path")).agg(F.count("*").alias("m_n"), F.sum("leaves").alias("m_leaves"), F.sum("saved").alias("m_saved"))
        met = rest.join(sent, "path", "left").na.fill(0, ["m_n", "m_leaves", "m_saved"])
        open_ = cut(met.select("path", "above", "hangs_on", (F.col("remaining") - F.col("m_n")).alias("remaining"), (F.col("leaves") + F.col("m_leaves")).alias("leaves"), (F.col("saved") + F.col("m_saved")).alias("saved")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each node's pieces, which come in order; nothing but the hash under way is kept."""
    node, made = None, None

    def out(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])

    for batch in batches:
        rows = []
        for n, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n != node:
                if made:
                    rows.append((node, made.hexdigest()))
                node, made = n, hashlib.sha256(piece.encode())
            else:
                made.update(b"," + piece.encode())
        if rows:
            yield out(rows)
    if made:
        yield out([(node, made.hexdigest())])


def end_digests(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the conversations that end at a node: their ids, ascending, in pieces of at most PIECE ids that are joined before they meet."""
    ends = members.where("depth = total").select("node", "c", F.floor(F.col("c") / PIECE).alias("piece"))
    pieces = ends.groupBy("node", "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids")
    return dealt.mapInArrow(_digests, "node binary, ends_sha256 string")


def trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations (c, total) with turns (c, depth from 1, digest, size, total).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256), as op13_prefix_trie says. Without conversations there is no node, not even the root.
    """
    members = cut(memberships(conversations, turns))
    longest = F.min(F.struct((-F.col("total")).alias("l"), F.col("c").alias("c")))
    nodes = cut(
        members.groupBy("node").agg(F.min("c").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("parent").alias("parent"), F.max("size").alias("size"), longest.alias("l"))
        .select("node", "parent", "conv_id", "depth", "n_convs", F.col("l.c").alias("path"), ((F.col("n_convs") - 1) * F.col("size")).alias("own"))
    )
    runs = nodes.groupBy("path").agg(F.min_by("parent", "depth").alias("hangs_on"), F.sum("own").alias("saved"))
    above = nodes.select(F.col("node").alias("hangs_on"), F.col("path").alias("above"))
    totals = cut(path_totals(runs.join(above, "hangs_on", "left").withColumn("leaves", F.lit(1).cast("long"))))

    beside = totals.where("hangs_on is not null").groupBy(F.col("hangs_on").alias("node")).agg(F.sum("leaves").alias("b_leaves"), F.sum("saved").alias("b_saved"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, "node", "left").join(beside, "node", "left").na.fill(0, ["n_children", "b_leaves", "b_saved"])
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    whole = running(known, ["path"], [F.desc("depth")], -F.floor(F.col("depth") / SEGMENT), sums={"n_leaves": F.col("b_leaves") + leaf, "saved_tokens": F.col("b_saved") + F.col("own")})
    named = whole.join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left").join(end_digests(members), "node", "left")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    turns = cut(numbered(conversations))
    lengths = cut(turns.groupBy("c").agg(F.count("*").alias("total")))
    placed = turns.join(lengths, "c").select("c", (F.col("p") + 1).alias("depth"), "digest", "size", "total")
    return trie(lengths, placed)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations, a row for each node.

    Null roles and texts are empty; null turns come first, equal turns in order of
    their digests, so repeated rows are repeated turns. Rows without conv_id belong to no
    conversation. Very long texts are digested like others. A conversation without turns is a
    member of the root and ends there. No rows give no rows. Other columns aren't read.
    """
    turns = cut(numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return trie(*shared_starts(turns))


#: crc32 is written out, bit by bit.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT) % 6 AS h
  FROM t GROUP BY c),
r AS (
  SELECT n.c, g.p + 1 AS d, g.role, g.text FROM n JOIN t g ON g.c = n.c - n.c % 100 AND g.p < n.h
  UNION ALL
  SELECT t.c, t.p - n.h + least(n.h, coalesce(g.n, 0)) + 1, t.role, t.text FROM t JOIN n USING (c) LEFT JOIN n g ON g.c = n.c - n.c % 100 WHERE t.p >= n.h),
m AS (
  SELECT c, 0 AS d, '' AS k, NULL::VARCHAR AS parent, 0 AS size FROM n
  UNION ALL
  SELECT m.c, r.d, sha256(concat(m.k, ':', length(r.role), ':', r.role, r.text)), m.k, length(r.text) FROM m JOIN r ON r.c = m.c AND r.d = m.d + 1),
last AS (SELECT c, max(d) AS d FROM m GROUP BY c),
v AS (SELECT k, any_value(d) AS depth, any_value(parent) AS parent, any_value(size) AS size, min(c) AS conv_id, count(*) AS n_convs FROM m GROUP BY k),
e AS (SELECT m.k, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS ends FROM m JOIN last ON last.c = m.c AND last.d = m.d GROUP BY m.k),
ch AS (SELECT parent AS k, count(*) AS n FROM v WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT x.k AS top, y.k AS k FROM m x JOIN m y ON x.c = y.c AND y.d >= x.d),
s AS (SELECT top AS k, sum((v.n_convs - 1) * v.size) AS saved, count(*) FILTER (ch.n IS NULL) AS leaves FROM below JOIN v ON v.k = below.k LEFT JOIN ch ON ch.k = below.k GROUP BY top)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(ch.n, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM v JOIN s ON s.k = v.k LEFT JOIN v u ON u.k = v.parent LEFT JOIN ch ON ch.k = v.k LEFT JOIN e ON e.k = v.k
"""
