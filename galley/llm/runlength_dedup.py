"""Removal of long repeated byte strings with run-length compressed suffix indexes.

Every window of ``length`` bytes is assigned, by content alone, to the least hash among its k-mers; consecutive windows
with the same least hash form a segment.  Equal windows have equal keys wherever they stand, so the corpus can be dealt
out by key and no repeat is lost between tasks.  Segments whose key occurs once, and once only in themselves, cannot
repeat and are left out before any text moves.  Equal segments, by key and 128-bit digest, are merged.  A key whose
distinct segments are too many for one index (a header that stands in many surroundings) is dealt out again by the
minimisers of longer k-mers, up to the whole window, so no task ever indexes more than a bounded text.  Each task then
indexes its segments: suffix order, Burrows-Wheeler transform, its runs, and samples at the run ends.  Only at these is a longest common extension
computed; streaming from sample to sample gives the matching statistics of all other positions, as these fall by one a
byte in between.  Windows whose statistic reaches ``length`` start somewhere else too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, stored

LENGTH = 400
#: Bytes of a k-mer, and of the longer ones by which overfull keys are dealt out again before whole windows are.
KMER, LONGER = 32, (128, 256, 384)
#: Texts are hashed, and segments indexed, in groups of about so many bytes; a key of more distinct text is overfull.
GROUP_BYTES, INDEX_BYTES = 1_000_000, 2_000_000
BYTE_CODES = np.random.default_rng(10).integers(1, 2**63, 256, dtype=np.uint64)
C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
#: Bytes that UTF-8 never has: one parts the segments of an index, the others end it.
SEPARATOR, TAIL = b"\xff", b"\xfe" * 8


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number (read in place)."""
    return np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))


def _kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    n = len(data) - k + 1
    if k == KMER:
        v = _words(data)
        h = v[:n] * C[0] + v[8 : 8 + n] * C[1] + v[16 : 16 + n] * C[2] + v[24 : 24 + n] * C[3]
    else:  # differences of prefix sums of a polynomial, brought to the same power
        base = C[0] | np.uint64(1)
        power, back = np.full(len(data), base), np.full(n, np.uint64(pow(int(base), -1, 2**64)))
        power[:1] = back[:1] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[data] * np.multiply.accumulate(power), dtype=np.uint64)])
        h = (sums[k:] - sums[:n]) * np.multiply.accumulate(back)
    h ^= h >> np.uint64(29)
    h *= C[4]
    h ^= h >> np.uint64(32)
    return h


def _sliding(h: np.ndarray, width: int, best=np.minimum, fill=np.uint64(2**64 - 1)) -> np.ndarray:
    """Least (or greatest) of every ``width`` neighbours, by block-wise running minima from both sides."""
    n = len(h)
    blocks = np.full(-(-n // width) * width, fill, np.uint64)
    blocks[:n] = h
    blocks = blocks.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return best(back[:m], ahead[width - 1 : width - 1 + m])


def segments(texts: list[bytes], length: int = LENGTH, k: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: ``(text number, key, first window, last window, weight)`` of its segments.

    weight is 2 if the key's k-mer stands at two places of the segment, which may then repeat within itself, else 1.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    width = length - k + 1
    h = _kmer_hashes(data, k)
    least = _sliding(h, width)
    ends = np.cumsum(sizes)
    text_of = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
    begins = ends - sizes
    counts = np.maximum(sizes - length + 1, 0)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[text_of]  # window starts inside one text
    key = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (text_of[1:] != text_of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    # places where a k-mer is the least of some window: it equals the greatest of the window minima around it
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    places = np.flatnonzero(_sliding(padded, width, np.maximum, np.uint64(0)) == h)
    twice = places[1:][(h[places[1:]] == h[places[:-1]]) & (places[1:] - places[:-1] <= width)]
    lo, hi = at[first], at[last] + width - 1
    near = np.minimum(np.searchsorted(twice, lo, "right"), max(len(twice) - 1, 0))
    weight = np.ones(len(first), np.int64)
    if len(twice):
        weight[(twice[near] > lo) & (twice[near] <= hi)] = 2
    return text_of[first], key[first].view(np.int64), at[first] - begins[text_of[first]], at[last] - begins[text_of[last]], weight


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix order by doubling, in which only positions that are still tied are sorted again.

    The data must end with TAIL, which stands nowhere else, so no comparison runs over the end.
    """
    n = len(data)
    padded = np.zeros(n + 7, np.uint8)
    padded[:n] = data
    first = _words(padded).byteswap()
    order = np.argsort(first)
    fresh = np.ones(n, bool)
    fresh[1:] = first[order[1:]] != first[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    tied = order[~(fresh & np.append(fresh[1:], True))]
    size = 8
    while len(tied):
        key = rank[tied] * n + rank[tied + size]
        o = np.argsort(key)
        tied, key = tied[o], key[o]
        group = rank[tied]
        head, fresh, i = np.ones(len(tied), bool), np.ones(len(tied), bool), np.arange(len(tied))
        head[1:] = group[1:] != group[:-1]
        fresh[1:] = key[1:] != key[:-1]
        rank[tied] = group + np.maximum.accumulate(np.where(fresh, i, 0)) - np.maximum.accumulate(np.where(head, i, 0))
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        size *= 2
    order[rank] = np.arange(n)
    return order


def extensions(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common extension from each pair of positions."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    words = _words(padded)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    a, b = a.copy(), b.copy()
    while len(live):
        x = words[a] ^ words[b]
        same = x == 0
        low = x[~same] & (~x[~same] + np.uint64(1))
        out[live[~same]] += (np.log2(low.astype(np.float64)) // 8).astype(np.int64)
        live, a, b = live[same], a[same] + 8, b[same] + 8
        out[live] += 8
        go = np.maximum(a, b) < n
        live, a, b = live[go], a[go], b[go]
    return out


def matching_statistics(data: np.ndarray) -> np.ndarray:
    """For each position the length of the longest string that starts there and somewhere else, from samples at run ends.

    The data must end with TAIL.
    """
    n = len(data)
    order = suffix_array(data)
    before = np.where(order > 0, data[order - 1].astype(np.int16), -1)  # the transform
    head = np.ones(n, bool)
    head[1:] = before[1:] != before[:-1]
    runs = np.flatnonzero(head)
    best = np.zeros(n, np.int64)
    # a run's first suffix and the one above it; a run's last suffix and the one below: inside a run the statistic of the
    # position one further left is greater by one, so only these samples are compared
    for mine, other in ((runs[1:], runs[1:] - 1), (runs[1:] - 1, runs[1:])):
        value, sampled = np.zeros(n, np.int64), np.zeros(n, bool)
        value[order[mine]] = extensions(data, order[mine], order[other])
        sampled[order[mine]] = True
        sampled[order[0 if other[0] < mine[0] else -1]] = True  # nothing above the first suffix, nothing below the last
        sampled[0] = True
        last = np.maximum.accumulate(np.where(sampled, np.arange(n), 0))
        best = np.maximum(best, value[last] - (np.arange(n) - last))
    return best


def repeated_windows(parts: list[bytes], copies: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each of these distinct segments, the ranges ``[start, end)`` of bytes under windows that start elsewhere too."""
    data = np.frombuffer(SEPARATOR.join(parts) + SEPARATOR + TAIL, np.uint8)
    stat = matching_statistics(data)
    out, at = [], 0
    for part, n in zip(parts, copies, strict=True):
        starts = len(part) - length + 1
        if n > 1:
            out.append([(0, len(part))])
        else:
            on = np.flatnonzero(np.diff(np.concatenate([[0], stat[at : at + starts] >= length, [0]]).astype(np.int8)))
            out.append([(int(a), int(b) - 1 + length) for a, b in zip(on[::2], on[1::2], strict=True)])
        at += len(part) + 1
    return out


def _batches(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each."""
    edges = np.flatnonzero(np.diff(np.cumsum(lengths) // most)) + 1
    return [(int(a), int(b)) for a, b in zip([0, *edges], [*edges, len(lengths)], strict=True) if b > a]


def _find_segments(length: int, k: int):
    """Segments of each text and their digests: with the key, which depends on the same bytes, their identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _batches(pc.binary_length(batch["bytes"]).to_numpy(zero_copy_only=False).astype(np.int64), GROUP_BYTES):
                part = batch.slice(a, b - a)
                texts = part["bytes"].to_pylist()
                row, key, first, last, weight = segments(texts, length, k)
                views = [memoryview(t) for t in texts]
                digests = b"".join(hashlib.md5(views[r][x : y + length]).digest() for r, x, y in zip(row.tolist(), first.tolist(), last.tolist(), strict=True))
                offsets = pa.py_buffer(np.arange(0, 16 * len(row) + 1, 16, dtype=np.int32))
                rows = pa.array(row)
                columns = [part["id"].take(rows), part["part_id"].take(rows), pa.array(key), pa.Array.from_buffers(pa.binary(), len(row), [None, offsets, pa.py_buffer(digests)])]
                columns += [pa.array(x, pa.int32()) for x in (first, last, weight)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "part_id", "key", "part", "first", "last", "weight"])

    return run


def _index(length: int):
    """Rows come sorted by key and segment; whole keys are gathered up to INDEX_BYTES, then indexed together."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def emit(held: list[tuple]) -> pa.RecordBatch:
        spans = repeated_windows([r[3] for r in held], [r[2] for r in held], length)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.binary()), pa.array([[{"a": x, "b": y} for x, y in s] for s in spans], kind)], ["key", "part", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("key", "part", "n", "bytes")), strict=True):
                if size >= INDEX_BYTES and row[0] != held[-1][0]:
                    yield emit(held)
                    held, size = [], 0
                if held and row[:2] == held[-1][:2]:  # of a repeated row
                    continue
                held.append(row)
                size += len(row[3]) + 1
        if held:
            yield emit(held)

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in _batches(pc.binary_length(batch["bytes"]).to_numpy(zero_copy_only=False).astype(np.int64), GROUP_BYTES):
            part = batch.slice(a, b - a)
            kept, removed = [], []
            for data, ranges in zip(part["bytes"].to_pylist(), part["ranges"].to_pylist(), strict=True):
                spans: list[list[int]] = []
                for x in sorted((r["a"], r["b"]) for r in ranges or ()):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append(list(x))
                edges = [0, *(e for s in spans for e in s), len(data)]
                kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                removed.append([{"start": x, "end": y} for x, y in spans])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(d) for d in part["bytes"].to_pylist()], pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])


def repeated_ranges(units: DataFrame, length: int = LENGTH, overfull: int = INDEX_BYTES, kmers: tuple[int, ...] = (KMER, *LONGER)) -> DataFrame:
    """``units(id, part_id, bytes)``, the ids together a key -> ``id, part_id, ranges array<struct<a,b>>``: the bytes
    under windows that start elsewhere too, be it in the same unit; possibly several rows for a unit.
    """
    k = min([*kmers, length][0], length)
    types = [units.schema[c].dataType.simpleString() for c in ("id", "part_id")]
    found = stored(units.mapInArrow(_find_segments(length, k), f"id {types[0]}, part_id {types[1]}, key long, part binary, first int, last int, weight int"))
    again = found.groupBy("key").agg(F.sum("weight").alias("times")).where("times > 1").select("key")
    repeated = stored(found.join(again, "key").drop("weight"))
    # one occurrence of each distinct segment stands for all; a key of one copied segment needs no text: all of it repeats
    one = repeated.groupBy("key", "part").agg(F.count("*").alias("n"), F.min(F.struct("id", "part_id", "first", "last")).alias("at"))
    size = F.col("at.last") - F.col("at.first") + length
    keys = one.groupBy("key").agg(((F.count("*") == 1) & (F.max("n") > 1)).alias("whole"), (F.sum(size) > overfull).alias("hot"))
    # whole windows as k-mers: one key is one window, so of an overfull key everything repeats
    one = stored(one.join(keys, "key").withColumn("whole", F.col("whole") | (F.col("hot") & F.lit(k == length))))
    everything = F.array(F.struct(F.lit(0).alias("a"), size.alias("b")))
    whole = one.where("whole").select("key", "part", everything.alias("ranges"))
    wanted = one.where("not whole").groupBy(F.col("at.id").alias("wanted_id"), F.col("at.part_id").alias("wanted_part")).agg(F.collect_list(F.struct("key", "part", "n", "hot", "at.first", "at.last")).alias("segments"))
    same = F.col("part_id").eqNullSafe(F.col("wanted_part")) & F.col("id").eqNullSafe(F.col("wanted_id"))
    cut_up = units.join(wanted.hint("shuffle_hash"), same, "left").where("segments is not null").select("bytes", F.explode("segments").alias("s"))
    texts = cut_up.select("s.key", "s.part", "s.n", "s.hot", F.expr(f"substring(bytes, s.first + 1, s.last - s.first + {length})").alias("bytes"))
    crowded = not one.where("hot and not whole").isEmpty()
    if crowded:
        texts = stored(texts)
    indexed = texts.where("not hot").select("key", "part", "n", "bytes").repartition("key").sortWithinPartitions("key", "part").mapInArrow(_index(length), "key long, part binary, ranges array<struct<a:int,b:int>>").where("size(ranges) > 0")
    marks = indexed.union(whole)
    if crowded:
        # repeated rows of a unit give a segment's text more than once
        hot = texts.where("hot").dropDuplicates(["key", "part"])
        copied = hot.where("n > 1").select("key", "part", F.array(F.struct(F.lit(0).alias("a"), F.octet_length("bytes").alias("b"))).alias("ranges"))
        deeper = repeated_ranges(hot.select(F.col("key").alias("id"), F.col("part").alias("part_id"), "bytes"), length, overfull, kmers[1:])
        marks = marks.union(copied).union(deeper.select("id", "part_id", "ranges"))
    met = repeated.join(cut(marks), ["key", "part"])
    moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b")))
    return met.select("id", "part_id", moved.alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, overfull: int = INDEX_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_bytes, removed array<struct<start,end>>, kept binary``, a row per document.

    A byte is removed if a string of ``length`` bytes over it also starts anywhere else, be it in the same document.
    Strings never cross documents and are judged on the input.  Null counts as empty; repeated rows (null ids, or one id
    for several texts, included) are copies of one another, so what is long enough in them goes; an empty table gives an
    empty result; other columns are not looked at.  Keys of more than ``overfull`` bytes of distinct text are dealt out
    again.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = docs.select(F.col("doc_id").alias("doc_id"), data.alias("bytes"), F.xxhash64("doc_id", data).alias("digest"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    marked = repeated_ranges(docs.select(F.col("doc_id").alias("id"), F.col("digest").alias("part_id"), "bytes"), length, overfull)
    ranges = marked.groupBy("id", "part_id").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    same = F.col("digest").eqNullSafe(F.col("part_id")) & F.col("doc_id").eqNullSafe(F.col("id"))
    joined = docs.join(ranges.hint("shuffle_hash"), same, "left").select("doc_id", "bytes", "ranges")
    return joined.mapInArrow(_cut_out, f"doc_id {id_type}, n_bytes long, removed array<struct<start:int,end:int>>, kept binary")
