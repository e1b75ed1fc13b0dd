"""N-gram Jaccard self-join by chosen paths.

Texts become sets of word shingles, and a set an embedding of min-wise tokens (coordinate, value).  A node of the
recursion samples a few coordinates; sets that share a sampled token go on together to that child.  Buckets that have
become small are compared by brute force; runs repeat from fresh roots until the target recall.  Buckets that similarity
itself keeps large are compared in blocks, unless their sets are linked already.  What is linked this way is only a
candidate group: exact Jaccard on the full sets, all pairs of a group in blocks, decides every link.  Pairs are never
written out; each block returns the number of links of every set and a spanning forest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, cut, stored

#: Words of a shingle and least similarity, in hundredths.
WORDS, PERCENT = 5, 80
#: Coordinates of an embedding; coordinates that a node samples on average; levels; sets that brute force takes.
COORDINATES, SAMPLED, LEVELS, BRUTE = 64, 2.0, 3, 512
TARGET_RECALL = 0.999
#: Turns in which the sets of large buckets meet leaders.
LEADERS = 2
#: Rows of a block where large groups are compared in blocks.
BLOCK = 512
#: Rows of a block of a large bucket that a block of probes is compared with.
BUCKET_BLOCK = 4096
#: Embeddings that agree on less than this share are no candidates: four and a half standard deviations below PERCENT.
AGREE = PERCENT / 100 - 4.5 * math.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / COORDINATES)

P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_rng = np.random.default_rng(20)
FACTORS = _rng.integers(1, 2**63, (COORDINATES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def recall_of(runs: int) -> float:
    """Probability that a pair at the threshold becomes a candidate on the deepest level: over the coordinates that its
    embeddings, the same in all runs, agree on, it passes AGREE and meets in one of the runs."""
    total = 0.0
    for k in range(math.ceil(AGREE * COORDINATES), COORDINATES + 1):
        met = 1.0
        for _ in range(LEVELS):
            met = 1 - math.exp(-SAMPLED * k / COORDINATES * met)
        total += math.comb(COORDINATES, k) * (PERCENT / 100) ** k * (1 - PERCENT / 100) ** (COORDINATES - k) * (1 - (1 - met) ** runs)
    return total


def runs_needed(recall: float = TARGET_RECALL) -> int:
    """Least number of runs of this recall; no number of runs makes up for what AGREE drops."""
    if recall_of(10**6) < recall:
        raise ValueError(f"AGREE does not allow a recall of {recall}")
    return next(runs for runs in range(1, 10**6) if recall_of(runs) >= recall)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: _Hashes) -> np.ndarray:
    """Hashes of the distinct shingles in order; a text of fewer words, but not none, is one shingle.

    Words are what white space parts, with A-Z lowered.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    size = min(WORDS, len(words))
    if not size:
        return h
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out = out * P1 + h[k : len(h) - size + 1 + k]
    out ^= out >> np.uint64(31)
    return np.unique(out * P2)


def embedding(tokens: np.ndarray) -> np.ndarray:
    """For each coordinate the least of the tokens under its own hash."""
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for a in range(0, len(tokens), 4096):
        x = tokens[a : a + 4096] * FACTORS
        x ^= x >> np.uint64(32)
        x *= P1
        least = np.minimum(least, x.min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        for a in range(0, len(batch), 1000):
            part = batch.slice(a, 1000)
            nodes, emb = [], []
            for text in part["text"]:
                tokens = shingles(text.as_py(), hashes)
                nodes.append(int.from_bytes(hashlib.md5(tokens.tobytes()).digest()[:8], "little", signed=True) if len(tokens) else None)
                emb.append(embedding(tokens).tobytes() if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["digest"], pa.array(nodes, pa.int64()), pa.array(emb, pa.binary())], ["doc_id", "digest", "node", "embedding"])


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least member of the component of each of ``n`` items that the links (a, b) join."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, least)
        np.minimum.at(fresh, b, least)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """Tables of whole groups (rows come sorted by ``keys``) of about ``most`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= most:
            table = pa.Table.from_batches(held)
            last = [table[k][-1].as_py() for k in keys]
            same = np.logical_and.reduce([np.asarray(pa.compute.equal(table[k], v)) for k, v in zip(keys, last, strict=True)])
            cut_at = int(np.argmax(same))
            if cut_at:
                yield table.slice(0, cut_at)
            held, rows = table.slice(cut_at).to_batches(), len(table) - cut_at
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, COORDINATES)


def _links(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    label = spanning(a, b, len(nodes))
    on = np.flatnonzero((label != np.arange(len(nodes))) & (nodes[label] != nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(nodes[label[on]])], ["src", "dst"])


def _brute_force(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small buckets: every row is compared with the next ones of its bucket, all buckets at once."""
    for table in _grouped(batches, ["path"], 40_000):
        path, nodes, emb = table["path"].to_numpy(), table["node"].to_numpy(), _matrix(table["embedding"])
        found = []
        for step in range(1, BRUTE):
            i = np.flatnonzero(path[step:] == path[:-step])
            if not len(i):
                break
            found.append(np.stack([i, i + step])[:, (emb[i] == emb[i + step]).mean(axis=1) >= AGREE])
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        yield _links(nodes, a, b)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Large buckets: a block of probes against a block of rows; links to other components than their own."""
    for table in _grouped(batches, ["path", "x", "y"], 1):
        for part in _split(table, ["path", "x", "y"]):
            nodes, comp, emb = part["node"].to_numpy(), part["component"].to_numpy(), _matrix(part["embedding"])
            probe = part["probe"].to_numpy(zero_copy_only=False)
            probes, rows = np.flatnonzero(probe), np.flatnonzero(~probe)
            agree = np.zeros((len(probes), len(rows)), np.int16)
            for c in range(COORDINATES):
                agree += emb[probes, c][:, None] == emb[rows, c][None, :]
            i, j = np.nonzero((agree >= AGREE * COORDINATES) & (comp[probes][:, None] != comp[rows][None, :]))
            src, dst = np.unique(np.stack([nodes[probes[i]], comp[rows[j]]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])


def _split(table: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        v = table[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    at = [*np.flatnonzero(new), len(table)]
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield table.slice(a, b - a)


def exact_links(sets: list[np.ndarray]) -> np.ndarray:
    """Which of these sets have a Jaccard similarity of at least PERCENT hundredths, as a square matrix."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        inter = np.zeros((2, 2), np.int64)
        inter[0, 1] = inter[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        tokens, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        rank = np.cumsum(times > 1) - 1
        shared = times[column] > 1
        row, column = row[shared], rank[column[shared]]
        inter = np.zeros((len(sets), len(sets)), np.float64)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, [lo, lo + 4096])
            dense = np.zeros((len(sets), 4096), np.float32)
            dense[row[a:b], column[a:b] - lo] = 1
            inter += dense @ dense.T
        inter = np.rint(inter).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    linked = inter * 100 >= PERCENT * union
    np.fill_diagonal(linked, False)
    return linked


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        for a in range(0, len(batch), 500):
            part = batch.slice(a, 500)
            sets = [shingles(t.as_py(), hashes).tobytes() for t in part["text"]]
            yield pa.RecordBatch.from_arrays([part["grp"], part["node"], part["weight"], part["blocks"], pa.array(sets, pa.binary())], ["grp", "node", "weight", "blocks", "tokens"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _grouped(batches, ["grp", "x", "y"], 200):
        for part in _split(table, ["grp", "x", "y"]):
            _, once = np.unique(part["node"].to_numpy(), return_index=True)  # repeated rows of one text
            part = part.take(once)
            nodes, weight, block = (part[k].to_numpy() for k in ("node", "weight", "block"))
            if len(nodes) < 2:
                continue
            linked = exact_links([np.frombuffer(t, np.uint64) for t in part["tokens"].to_pylist()])
            if part["x"][0].as_py() != part["y"][0].as_py():  # pairs within one block are counted there
                linked &= block[:, None] != block[None, :]
            a, b = np.nonzero(np.triu(linked))
            label = spanning(a, b, len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(linked @ weight), pa.array(nodes[label])], ["node", "links", "root"])


def _children(path: Column, embedding: Column) -> Column:
    """The tokens that a node samples from a set, each the path of a child."""
    sampled = lambda i: F.pmod(F.xxhash64(path, i), F.lit(COORDINATES * 1000)) < int(SAMPLED * 1000)
    value = lambda i: F.substring(embedding, i * 4 + 1, F.lit(4))
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), sampled), lambda i: F.xxhash64(path, i, value(i)))


def _in_blocks(count: Column, node: Column, size: int | None = None) -> tuple[Column, Column]:
    """Number of blocks of a group, and a row's block in it."""
    n = F.ceil(count / (size or BLOCK)).cast("int")
    return n, F.pmod(F.xxhash64(node), n).cast("int")


def _probe_blocks(mixed: DataFrame) -> DataFrame:
    """``mixed(path, node, component, other, n, k)`` -> ``path, x, y, probe, node, component``: block x of the bucket's n
    rows meets block y of the n - k others, once as rows and once as probes."""
    (rows, x), (probes, y) = _in_blocks(F.col("n"), F.col("node"), BUCKET_BLOCK), _in_blocks(F.col("n") - F.col("k"), F.col("node"))
    upto = lambda count: F.sequence(F.lit(0), count - 1)
    as_row = F.transform(upto(probes), lambda i: F.struct(x.alias("x"), i.alias("y"), F.lit(False).alias("probe")))
    as_probe = F.transform(upto(rows), lambda i: F.struct(i.alias("x"), y.alias("y"), F.lit(True).alias("probe")))
    both = F.when(F.col("other"), F.concat(as_row, as_probe)).otherwise(as_row)
    return mixed.select("path", "node", "component", F.explode(both).alias("p")).select("path", "p.*", "node", "component")


def _placed(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``members(path, node)`` with the ``component`` of each set; a set that nothing links is its own."""
    return members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _majors(placed: DataFrame, *more: Column) -> DataFrame:
    """``path, major, n, k`` of the buckets with more than one component: the largest one's name, all sets and its sets;
    ``more`` are aggregates of that component."""
    names = [f"more{i}" for i in range(len(more))]
    shares = placed.groupBy("path", "component").agg(F.count("*").alias("k"), *[m.alias(x) for m, x in zip(more, names, strict=True)])
    largest = F.max_by(F.struct(F.col("component").alias("major"), *names), F.struct("k", "component")).alias("largest")
    return shares.groupBy("path").agg(largest, F.sum("k").alias("n"), F.max("k").alias("k")).where("k < n").select("path", "largest.*", "n", "k")


def _mixed(large: DataFrame, groups: DataFrame) -> DataFrame:
    """``path, node, component, other, n, k`` of the buckets with more than one component.

    The sets outside a bucket's largest component (``other``) probe all of it; pairs inside that are linked already.
    """
    placed = stored(_placed(large, groups))
    return placed.join(_majors(placed), "path").select("path", "node", "component", (F.col("component") != F.col("major")).alias("other"), "n", "k")


def _agree() -> Column:
    """Whether the embeddings ``embedding`` and ``e`` agree enough to be candidates."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda i: F.substring("embedding", i * 4 + 1, F.lit(4)) == F.substring("e", i * 4 + 1, F.lit(4))))
    return same >= AGREE * COORDINATES


def _stars(large: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, component`` of the sets of large buckets ``large(path, node)`` that agree with the leader of their most
    central bucket, which names their component."""
    ranked = large.join(large.groupBy("node").agg(F.count("*").alias("rank")), "node")
    leaders = ranked.groupBy("path").agg(F.max(F.struct("rank", "node")).alias("at"))
    wanted = ranked.join(leaders, "path").groupBy("node").agg(F.max("at").alias("at"))
    mine = stored(wanted.join(sets, "node").select("node", F.col("at.node").alias("leader"), "embedding"))
    other = mine.select(F.col("node").alias("leader"), F.col("embedding").alias("e"))
    return stored(mine.where("node <> leader").join(other, "leader").where(_agree()).select("node", F.col("leader").alias("component")))


def _led(large: DataFrame, sets: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``links`` with those of the sets of large buckets ``large(path, node)`` to leaders, and the components of all.

    A set is compared with one leader, not with one of each of its buckets: first with the leader of its most central
    bucket (a set that is in many buckets agrees with most of its group, so it leads), then, as long as it is outside
    the largest component of a bucket, with a member of that component and with a leader of those outside.
    """
    other = sets.select(F.col("node").alias("leader"), F.col("embedding").alias("e"))
    ranked = stored(large.join(large.groupBy("node").agg(F.count("*").alias("rank")), "node"))
    left, groups = ranked, None
    for turn in range(LEADERS):
        if turn:
            # other members of the largest component in each turn
            placed = stored(_placed(ranked, groups))
            majors = stored(_majors(placed, F.max_by(F.struct("rank", "node"), F.xxhash64("node", F.lit(turn)))))
            left = stored(placed.join(majors.withColumnRenamed("more0", "member"), "path").where("component <> major").select("path", "node", "rank", "member"))
            if left.isEmpty():
                break
        leaders = left.groupBy("path").agg(F.max(F.struct("rank", "node")).alias("at"))
        wanted = left.join(leaders, "path").where("node <> at.node").groupBy("node").agg(F.max("at").alias("at"))
        if turn:
            wanted = wanted.union(left.groupBy("node").agg(F.max("member").alias("at")))
        pairs = wanted.select("node", F.col("at.node").alias("leader")).distinct()
        near = pairs.join(sets, "node").join(other, "leader").where(_agree())
        links = stored(links.union(near.select(F.col("node").alias("src"), F.col("leader").alias("dst"))).distinct())
        groups = connected_components(links)
    return links, groups


def candidate_links(sets: DataFrame, runs: int) -> DataFrame:
    """``sets(node, embedding)`` -> links ``(src, dst)`` that join all candidates of a group.

    Buckets that similarity keeps large stay so however deep: on the first level their sets are linked to a leader, and
    only a bucket of more than BRUTE sets outside its largest component goes on to children; else those probe all of it
    at once, each set meeting BRUTE others at most, as in a small bucket.  At the last level sets are linked to leaders
    again, and what that leaves unlinked is compared in blocks.
    """
    roots = F.array(*[F.lit(r).cast("long") for r in range(1, runs + 1)])
    frontier = sets.select("node", F.explode(F.flatten(F.transform(roots, lambda r: _children(r, F.col("embedding"))))).alias("path"))
    leaves, stars, probed = None, None, None
    for level in range(LEVELS):
        frontier = cut(frontier)  # a set reaches a path once: its parent and the sampled coordinate are part of it
        counts = frontier.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        met = frontier.join(counts, "path")
        small, large = met.where(F.col("n") <= BRUTE).select("path", "node"), met.where(F.col("n") > BRUTE).select("path", "node")
        leaves = small if leaves is None else leaves.union(small)
        if not level:
            large = cut(large)
            if large.isEmpty():
                break
            stars = _stars(large, sets)
            mixed = stored(_mixed(large, stars))
            probed = mixed.where(F.col("n") - F.col("k") <= BRUTE)
            large = mixed.where(F.col("n") - F.col("k") > BRUTE).select("path", "node")
        if level < LEVELS - 1:
            frontier = large.join(sets, "node").select("node", F.explode(_children(F.col("path"), F.col("embedding"))).alias("path"))
    near = "src long, dst long"
    found = leaves.join(sets, "node").select("path", "node", "embedding").repartition("path").sortWithinPartitions("path").mapInArrow(_brute_force, near)
    if stars is None:
        return stored(found.distinct())
    links = stored(found.union(stars.toDF("src", "dst")).distinct())
    large = cut(large)
    mixed = probed
    if not large.isEmpty():
        links, groups = _led(large, sets, links)
        mixed = probed.union(_mixed(large, groups))
    probes = _probe_blocks(mixed).join(sets, "node").select("path", "x", "y", "probe", "node", "component", "embedding")
    rest = probes.repartition("path", "x", "y").sortWithinPartitions("path", "x", "y").mapInArrow(_probe, near)
    return cut(links.union(rest))


def text_digest() -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def near_duplicates(docs: DataFrame, runs: int | None = None, mark: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, class_id, n_links``, a row per document; with ``mark`` also ``digest`` (see
    ``text_digest``) and ``kept``, true for the rows of the least (doc_id, digest) of each class.

    A link joins two documents whose shingle sets have a Jaccard similarity of at least 0.8; class_id is the least
    doc_id that links lead to, n_links the number of other documents that a document is linked to itself, copies
    included.  Null texts and texts without words link to nothing and are classes of their own.  Repeated rows are
    copies of each other.  An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("digest", text_digest())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    embedded = cut(docs.select("doc_id", "digest", "text").mapInArrow(_embed, f"doc_id {id_type}, digest long, node long, embedding binary"))
    nodes = cut(embedded.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.count("*").alias("weight"), F.min("doc_id").alias("least_doc"), F.first("embedding").alias("embedding")))
    links = candidate_links(nodes.select("node", "embedding"), runs or runs_needed())
    groups = connected_components(links)
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    n, block = _in_blocks(F.col("n"), F.col("node"))
    members = groups.join(sizes, "component").join(nodes.drop("embedding"), "node").select(F.col("component").alias("grp"), "node", "weight", F.col("first.doc_id").alias("id"), F.col("first.digest").alias("dig"), F.struct(n.alias("n"), block.alias("block")).alias("blocks"))
    texts = docs.join(members.hint("shuffle_hash"), F.col("digest").eqNullSafe(F.col("dig")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("grp", "node", "weight", "blocks", "text")
    sets = texts.mapInArrow(_sets, "grp long, node long, weight long, blocks struct<n:int,block:int>, tokens binary")
    spread = sets.select("grp", "node", "weight", F.col("blocks.block").alias("block"), "tokens", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks.n") - 1), lambda k: F.struct(F.least("blocks.block", k).alias("x"), F.greatest("blocks.block", k).alias("y")))).alias("p"))
    checked = cut(spread.select("grp", "node", "weight", "block", "tokens", "p.x", "p.y").repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y").mapInArrow(_verify, "node long, links long, root long"))
    classes = connected_components(checked.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    linked = nodes.drop("embedding").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = linked.groupBy("component").agg(F.min("least_doc").alias("class_id"), F.min("first").alias("class_first"))
    counts = checked.groupBy("node").agg(F.sum("links").alias("links"))
    info = linked.join(least, "component").join(counts, "node", "left").select("node", "class_id", "class_first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = embedded.select("doc_id", "digest", "node").join(info, "node", "left")
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    extra = ["digest", (F.col("node").isNull() | F.struct("doc_id", "digest").eqNullSafe(F.col("class_first"))).alias("kept")] if mark else []
    return out.select("doc_id", class_id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *extra)


ORACLE_SQL = r"""
WITH RECURSIVE ws AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM ws WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 100 >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
degree AS (SELECT a AS doc_id, count(*) AS k FROM links GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links FROM documents JOIN classes USING (doc_id) LEFT JOIN degree USING (doc_id)
"""
