"""The prefix trie of conversations, built by van Emde Boas recursion over DataFrames.

A trie of depth D is cut at half depth: the prefixes that reach the cut are named, the upper trie above the cut and the
forest of lower tries below the named prefixes are built in the same way, and the totals of the lower tries are grafted
onto the upper one.  All tries of one level of the recursion are handled in the same joins, so D levels take log2(D)
rounds.  A row is one turn of one conversation: a conversation of very many turns is never in one row or task.

* Names: digests of aligned blocks of turns are made from those of their halves, upwards; then, from the largest
  block down, the name of a cut is the digest of the name of the cut before it and the block between them.
* Totals: upwards again, the sums of the lower tries under a cut go to every node between it and the cut before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored

#: Members' ids are listed by ranges of so many ids: the most that one row ever holds.
ENDS_BLOCK = 4096
#: Turns of a conversation's head that the shared heads may replace are below this number.
HEADS = 9


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> ``conv_id, depth, digest, bytes``: turns numbered from 1 by ``turn``, null first.

    Null role and text are empty; turns of the same number are ordered by the digest of role and text, so that repeated
    rows are all counted.  Rows without conv_id belong to no conversation.  The rows are sorted over all tasks by ranges
    and numbered by each task's own counts, so that a conversation with very many turns is spread over many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.select("conv_id", "digest", "bytes", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("place")))
    # a conversation's rows in one task are neighbours there; the window sees a row for each conversation and task only
    shares = placed.groupBy("conv_id", "task").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = shares.select("conv_id", "task", "first", before.alias("before"))
    return placed.join(offsets, ["conv_id", "task"]).select("conv_id", (F.col("before") + F.col("place") - F.col("first") + 1).alias("depth"), "digest", "bytes")


def with_shared_heads(turns: DataFrame, length: DataFrame, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of c - c % group in place of its own first h, where h is the unsigned crc32 of
    c's decimals modulo 9: ``(turns, length)`` of the results, which may have no turn."""
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    base = F.col("conv_id") - F.col("conv_id") % group
    sizes = length.select("conv_id", "length", h.alias("h"), base.alias("base"))
    given = length.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    plan = stored(sizes.join(given, "base", "left").select("conv_id", "base", "h", "length", F.least("h", F.coalesce("base_length", F.lit(0))).alias("taken")))
    heads = turns.where(F.col("depth") < HEADS).withColumnRenamed("conv_id", "base")
    taken = plan.join(heads, "base").where("depth <= h").select("conv_id", "depth", "digest", "bytes")
    own = turns.where(F.col("depth") > h).join(plan.select("conv_id", "h", "taken"), "conv_id").select("conv_id", (F.col("taken") + F.col("depth") - F.col("h")).alias("depth"), "digest", "bytes")
    rest = F.greatest(F.col("length") - F.col("h"), F.lit(0))
    return taken.union(own), plan.select("conv_id", (F.col("taken") + rest).alias("length"))


def _prefix_names(turns: DataFrame, length: DataFrame, levels: int) -> DataFrame:
    """``conv_id, depth, name`` of every prefix: equal names for equal prefixes."""
    blocks = [turns.select("conv_id", (F.col("depth") - 1).alias("block"), "digest")]
    for _ in range(levels - 1):
        half = lambda odd: F.max(F.when(F.col("block") % 2 == odd, F.col("digest")))
        pairs = blocks[-1].groupBy("conv_id", F.shiftright("block", 1).alias("block")).agg(half(0).alias("a"), half(1).alias("b"))
        blocks.append(stored(pairs.where("a is not null and b is not null").select("conv_id", "block", _digest(F.col("a"), F.col("b")).alias("digest"))))
    names = length.select("conv_id", F.lit(0).cast("long").alias("depth"), F.unhex(F.lit("00")).alias("name"))
    for level in reversed(range(levels)):
        step = blocks[level].where("block % 2 = 0").select("conv_id", F.shiftleft("block", level).alias("depth"), "digest")
        cuts = names.join(step, ["conv_id", "depth"]).select("conv_id", (F.col("depth") + 2**level).alias("depth"), _digest(F.col("name"), F.col("digest")).alias("name"))
        names = stored(names.union(cuts))
    return names


def _graft(nodes: DataFrame, names: DataFrame, levels: int, sums: tuple[str, ...]) -> DataFrame:
    """``name, *sums`` over each node's subtree, from ``nodes(name, parent, conv_id, depth, *sums)``; the root is not among them."""
    totals = nodes
    for level in range(levels):
        half = 2**level
        tops = totals.where((F.col("depth") - 1) % (2 * half) == half)
        # what hangs below a cut, with a conversation that goes through it
        roots = tops.groupBy("parent").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(s).alias(s) for s in sums])
        roots = roots.select("conv_id", F.shiftright(F.col("depth") - 2, level).alias("block"), *sums)
        above = names.where("depth > 0").select("conv_id", F.shiftright(F.col("depth") - 1, level).alias("block"), "name")
        more = roots.join(above, ["conv_id", "block"]).groupBy("name").agg(*[F.sum(s).alias(f"more_{s}") for s in sums])
        added = [(F.col(s) + F.coalesce(f"more_{s}", F.lit(0))).alias(s) for s in sums]
        totals = stored(totals.join(more, "name", "left").select("name", "parent", "conv_id", "depth", *added))
    return totals


def _ends(names: DataFrame, length: DataFrame, block: int) -> DataFrame:
    """``name, ends``: SHA-256 of the ascending ids, joined by commas, of the conversations that end in a node.

    Ids are listed by ranges of ``block`` ids.  A node with several lists has them hashed one after the other, in
    order, without ever joining them.
    """
    at_end = names.join(length.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"])
    lists = at_end.groupBy("name", (F.col("conv_id") - F.pmod("conv_id", F.lit(block))).alias("low")).agg(F.array_sort(F.collect_set("conv_id")).alias("ids"))
    lists = stored(lists.select("name", "low", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")))
    held = lists.groupBy("name").agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    single = held.where("n = 1").select("name", F.sha2("ids", 256).alias("ends"))
    several = lists.join(held.where("n > 1").select("name"), "name", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, out = None, None, []
        for batch in batches:
            for key, ids in zip(batch["name"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if key != name:
                    if digest is not None:
                        out.append((name, digest.hexdigest()))
                    name, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
        if digest is not None:
            out.append((name, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], ["name", "ends"])

    streamed = several.repartition("name").sortWithinPartitions("name", "low").select("name", "ids").mapInArrow(run, "name binary, ends string")
    return single.union(streamed)


def prefix_trie(turns: DataFrame, length: DataFrame, ends_block: int = ENDS_BLOCK) -> DataFrame:
    """``turns(conv_id, depth, digest, bytes)`` and ``length(conv_id, length)`` -> a row per node of the trie:
    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends``.

    A node is a distinct sequence of first turns, from the root (no turns) on; it is named by its least member and its
    depth.  n_leaves and saved_tokens, (members - 1) times the bytes of the last turn, are sums over the node's subtree,
    itself included.  Without conversations there is no node.
    """
    turns = stored(turns)
    deepest = length.agg(F.max("length")).first()[0]
    if deepest is None:
        return turns.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *[F.col("bytes").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.lit("").alias("ends")).limit(0)
    levels = max(1, deepest.bit_length())
    names = _prefix_names(turns, length, levels)
    parents = names.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    rows = names.join(turns.select("conv_id", "depth", "bytes"), ["conv_id", "depth"], "left").join(parents, ["conv_id", "depth"], "left")
    members = rows.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("parent").alias("parent"))
    nodes = stored(members)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    owners = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    known = nodes.join(children, "name", "left").join(owners, "parent", "left").join(_ends(names, length, ends_block), "name", "left")
    own = F.coalesce((F.col("n_convs") - 1) * F.col("bytes"), F.lit(0)).alias("saved_tokens")
    n_children = F.coalesce("n_children", F.lit(0))
    known = stored(known.select("name", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", n_children.alias("n_children"), (n_children == 0).cast("long").alias("n_leaves"), own, F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends")))
    sums = ("n_leaves", "saved_tokens")
    below = _graft(known.where("depth > 0").select("name", "parent", "conv_id", "depth", *sums), names, levels, sums)
    root = below.where("depth = 1").agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(f"total_{s}") for s in sums])
    root = known.where("depth = 0").crossJoin(F.broadcast(root)).select("name", *[(F.col(s) + F.col(f"total_{s}")).alias(s) for s in sums])
    totals = below.select("name", *sums).union(root)
    return known.drop(*sums).join(totals, "name").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *sums, "ends")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of whole conversations as they are: see ``turns_of`` and ``prefix_trie``."""
    turns = stored(turns_of(conversations))
    return prefix_trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("length")))


ORACLE_SQL = """
WITH placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS d,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY d) AS ts FROM placed GROUP BY conv_id),
crc AS (SELECT conv_id, ts, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384))) % 9 AS h FROM own),
whole AS (SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS (SELECT conv_id, len(ts) AS n, d, ts[1:d] AS p FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM whole)),
members AS (SELECT conv_id, d, n, p, min(conv_id) OVER same AS top, count(*) OVER same AS n_convs FROM prefixes WINDOW same AS (PARTITION BY d, p)),
linked AS (SELECT m.*, u.top AS up, CASE WHEN m.d > 0 THEN (m.n_convs - 1) * strlen(m.p[m.d].text) ELSE 0 END AS saved FROM members m LEFT JOIN members u ON u.conv_id = m.conv_id AND u.d = m.d - 1),
nodes AS (SELECT top, d, any_value(up) AS up, any_value(n_convs) AS n_convs, any_value(saved) AS saved,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM linked GROUP BY top, d),
kids AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.up = nodes.top AND kids.d = nodes.d),
-- a conversation answers for the nodes whose least member it is: their sums from any depth down
answered AS (SELECT m.conv_id, m.top, m.d, sum(CASE WHEN m.top = m.conv_id AND f.n_children = 0 THEN 1 ELSE 0 END) OVER down AS leaves,
    sum(CASE WHEN m.top = m.conv_id THEN f.saved ELSE 0 END) OVER down AS saved
  FROM members m JOIN full_nodes f ON f.top = m.top AND f.d = m.d WINDOW down AS (PARTITION BY m.conv_id ORDER BY m.d DESC)),
totals AS (SELECT top, d, sum(leaves) AS leaves, sum(saved) AS saved FROM answered GROUP BY top, d)
SELECT f.top AS conv_id, f.d AS depth, f.up AS parent_conv_id, f.n_convs, f.n_children, CAST(t.leaves AS BIGINT) AS n_leaves,
  CAST(t.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN totals t ON t.top = f.top AND t.d = f.d
"""
