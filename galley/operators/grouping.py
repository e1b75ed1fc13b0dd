"""Words into lines, micro-blocks and blocks.

Placing a word depends on the lines that earlier words have made, but a word joins a line only where they overlap from
top to bottom.  So a piece falls apart into strips, between which no word stands: strips are found by a running maximum
of the words' lower edges, and dealt out over all tasks in bundles.  In a task one bundle at a time is placed in order.
Zones are windows; micro-blocks and blocks follow one another, so a task reads a piece's lines as a sorted stream and
remembers the open block only.

Lines and blocks of pieces that lie whole in one task are made in columns, many pieces at a time: what depends on earlier
words or lines is done for all strips in step, or only where neighbours belong together at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import is_badge, text_role
from .layout import macro_zones_windowed
from .lineage import written

KEYS = ("asset_id",)
#: A bundle of strips closes once it has so many words.
BUNDLE_WORDS = 2000
#: Pieces of more words are dealt out in bundles; others are a bundle of their own, and their words move once.
LONG_PIECE = 50_000
#: Rows of a batch that a task hands on.
BATCH_ROWS = 4000
#: Words or lines, at least, of the whole pieces that are looked at together.
BATCH_WORDS = 50_000
#: So many strips of similar sizes are placed in step, if they have less than twice so many words.
IN_STEP, LONGEST_IN_STEP = 16, 128
LINE_TYPE = "text string, x int, y int, w int, h int, confidence double, words array<int>"
MICRO_TYPE = "zone string, role string, text string, x int, y int, w int, h int, confidence double, lines array<int>, words array<int>"

# Least overlaps and gaps at which a word joins a line, and a line a block.
SURE_OVERLAP, LIKELY_OVERLAP, COLUMN_GAP = 0.45, 0.25, 0.34
MICRO_GAP, MICRO_OVERLAP, ALIGNED, ALIGNED_OVERLAP = 0.95, 0.32, 0.16, 0.18
BLOCK_GAP, BLOCK_OVERLAP = 0.85, 0.30
MACRO_SHARES, SUB_SHARES = (0.20, 0.22), (0.14, 0.18)
# Gaps and overlaps of the simple grouping.
SIMPLE_GAP, SIMPLE_LAST, SIMPLE_BLOCK, SIMPLE_APART = 1.55, 0.18, 0.22, (0.95, 0.10)
ALONE = {"sku", "price_main", "price_secondary", "promo_badge"}
JOINABLE = {"description", "date_range", "campaign"}


def _apart(a1: float, a2: float, b1: float, b2: float) -> float:
    return max(0.0, b1 - a2, a1 - b2)


def split_point(values: list[float], span: float, share: float) -> float | None:
    """Middle of the first largest gap of six or more values, if wide enough and with two values on both sides."""
    v = sorted(values)
    if len(v) < 6 or span <= 1e-6:
        return None
    gap, at = max((b - a, -i) for i, (a, b) in enumerate(zip(v, v[1:], strict=False)))
    at = -at
    wide = gap / span >= share and at + 1 >= 2 and len(v) - at - 1 >= 2
    return (v[at] + v[at + 1]) / 2 if wide else None


def _share(a1: int, a2: int, b1: int, b2: int) -> float:
    """Overlap of two intervals over the shorter one."""
    return max(0, min(a2, b2) - max(a1, b1)) / max(1, min(a2 - a1, b2 - b1))


class _Words:
    """The words of a strip in reading order, as columns."""

    def __init__(self, rows: dict[str, list]):
        self.x, self.y = rows["x"], rows["y"]
        self.x2 = [x + w for x, w in zip(self.x, rows["w"], strict=True)]
        self.y2 = [y + h for y, h in zip(self.y, rows["h"], strict=True)]

    def place(self) -> list[list[int]]:
        """Members of each line: every word goes to the open line that it continues best.

        A line is its edges and members; one that ends above all later words is closed.
        """
        tops = list(accumulate(reversed(self.y), min))[::-1]
        lines: list[list] = []
        still_open: list[list] = []
        for i, (x1, y1, x2, y2, top) in enumerate(zip(self.x, self.y, self.x2, self.y2, tops, strict=True)):
            if still_open and min(line[3] for line in still_open) <= top:
                still_open = [line for line in still_open if line[3] > top]
            best, chosen, high = None, None, y2 - y1
            for line in still_open:
                over = min(line[3], y2) - max(line[1], y1)
                if over <= 0:
                    continue
                height = max(1, line[3] - line[1])
                most = max(height, high)
                gap, reach = max(0.0, x1 - line[2], line[0] - x2), max(10.0, 2.8 * most)
                if gap > reach:
                    continue
                shared, off = over / max(1.0, min(height, high)), abs(y1 + high / 2 - (line[1] + line[3]) / 2)
                if shared >= SURE_OVERLAP or (shared >= LIKELY_OVERLAP and off <= max(3.0, 0.55 * most)):
                    score = 3 * shared - off / height - gap / reach
                    if best is None or score > best:
                        best, chosen = score, line
            if chosen is None:
                chosen = [x1, y1, x2, y2, [i]]
                lines.append(chosen)
                still_open.append(chosen)
            else:
                chosen[0], chosen[1], chosen[2], chosen[3] = min(chosen[0], x1), min(chosen[1], y1), max(chosen[2], x2), max(chosen[3], y2)
                chosen[4].append(i)
        return [line[4] for line in lines]


def _place_in_step(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The number of each word's line, as ``_Words.place`` has it, for strips of similar sizes, longest first: the k-th words of all
    of them are placed at once."""
    far = 2**40
    edges = np.zeros((4, len(sizes), int(sizes[0])), np.int64)
    edges[1], edges[3] = far, -far  # no word overlaps a line that is not there yet
    made = np.zeros(len(sizes), np.int64)
    placed = np.zeros(len(x1), np.int64)
    for k in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -k))  # strips of more than k words
        at, rows = starts[:n] + k, np.arange(n)
        word = [e[at][:, None] for e in (x1, y1, x2, y2)]
        lx1, ly1, lx2, ly2 = edges[:, :n, : max(1, int(made[:n].max()))]
        high = word[3] - word[1]
        over = np.minimum(ly2, word[3]) - np.maximum(ly1, word[1])
        height = np.maximum(1, ly2 - ly1)
        most = np.maximum(height, high)
        gap, reach = np.maximum(0.0, np.maximum(word[0] - lx2, lx1 - word[2])), np.maximum(10.0, 2.8 * most)
        shared, off = over / np.maximum(1.0, np.minimum(height, high)), np.abs(word[1] + high / 2 - (ly1 + ly2) / 2)
        fits = (over > 0) & (gap <= reach) & ((shared >= SURE_OVERLAP) | ((shared >= LIKELY_OVERLAP) & (off <= np.maximum(3.0, 0.55 * most))))
        score = np.where(fits, 3 * shared - off / height - gap / reach, -np.inf)
        best = score.argmax(1)
        joins = score[rows, best] > -np.inf
        line = np.where(joins, best, made[:n])
        made[:n] += ~joins
        for i, (e, wider) in enumerate(zip((x1, y1, x2, y2), (np.minimum, np.minimum, np.maximum, np.maximum), strict=True)):
            edges[i, rows, line] = np.where(joins, wider(edges[i, rows, line], e[at]), e[at])
        placed[at] = line
    return placed


def _placed_words(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Line of each word in its strip.  Strips are taken by classes of sizes; the few of a size, and very long ones, one by one."""
    placed = np.zeros(len(x1), np.int64)
    least = 2
    while (rest := sizes >= least).any():
        own = np.flatnonzero(rest & (sizes < 2 * least))
        if len(own) >= IN_STEP and least <= LONGEST_IN_STEP:
            own = own[np.argsort(-sizes[own], kind="stable")]
            at = np.repeat(starts[own], sizes[own]) + _within(sizes[own])
            placed[at] = _place_in_step(*(e[at] for e in (x1, y1, x2, y2)), np.cumsum(sizes[own]) - sizes[own], sizes[own])
        else:
            for i in own:
                part = slice(starts[i], starts[i] + sizes[i])
                strip = {"x": x1[part], "y": y1[part], "w": x2[part] - x1[part], "h": y2[part] - y1[part]}
                for line, members in enumerate(_Words({c: v.tolist() for c, v in strip.items()}).place()):
                    placed[starts[i] + np.array(members)] = line
        least *= 2
    return placed


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of groups that follow one another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _first(marks: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    begins = np.ones(len(marks), bool)
    np.not_equal(marks[1:], marks[:-1], out=begins[1:])
    return begins


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _means(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``sum(group) / len(group)`` to the last bit: Python's sum of floats is Neumaier's."""
    total, lost = values[starts].copy(), np.zeros(len(starts))
    longer = np.flatnonzero(sizes > 1)
    for i in longer[sizes[longer] > LONGEST_IN_STEP]:
        total[i] = sum(values[starts[i] : starts[i] + sizes[i]].tolist())
    longer = longer[sizes[longer] <= LONGEST_IN_STEP]
    k = 1
    while len(longer):
        t, v = total[longer], values[starts[longer] + k]
        both = t + v
        lost[longer] += np.where(np.abs(t) >= np.abs(v), (t - both) + v, (v - both) + t)
        total[longer] = both
        k += 1
        longer = longer[sizes[longer] > k]
    return np.where((lost != 0) & np.isfinite(lost), total + lost, total) / sizes


def _joined(texts: pa.Array, rows: np.ndarray, starts: np.ndarray, mark: str) -> pa.Array:
    """Texts of groups of ``rows``, joined and without white space at the ends."""
    made = pc.binary_join(_lists(texts.cast(pa.string()).take(pa.array(rows)), starts), mark)
    ends = np.frombuffer(made.buffers()[1], np.int32, len(made) + 1, made.offset * 4)
    filled = np.flatnonzero(ends[1:] > ends[:-1])
    if not len(filled):
        return made
    data = np.frombuffer(made.buffers()[2], np.uint8)
    edge = np.stack([data[ends[filled]], data[ends[filled + 1] - 1]])
    doubtful = filled[((edge <= 32) | (edge >= 127)).any(0)]
    return _replaced(made, doubtful, [t.strip() for t in made.take(pa.array(doubtful)).to_pylist()])


def _replaced(values: pa.Array, at: np.ndarray, by: list) -> pa.Array:
    mask = np.zeros(len(values), bool)
    mask[at] = True
    return pc.replace_with_mask(values, pa.array(mask), pa.array(by, values.type)) if len(at) else values


def _lists(values: pa.Array, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _columns_of(centres: list[float], x1: int, x2: int) -> list[bool] | None:
    """Which words of a line that a wide gap parts into two columns are left of it."""
    cut = split_point(centres, max(1, x2 - x1), COLUMN_GAP)
    left = [c < cut for c in centres] if cut is not None else []
    return left if min(sum(left), len(left) - sum(left)) >= 2 else None


def _badges_apart(box: np.ndarray, promo: np.ndarray) -> bool:
    """Whether the promotional words of a line (columns x1, y1, x2, y2) stand well apart."""
    a, b = ([*m[:, :2].min(0).tolist(), *m[:, 2:].max(0).tolist()] for m in (box[~promo], box[promo]))
    return _apart(a[0], a[2], b[0], b[2]) > max(12.0, 1.15 * max(8, min(a[3] - a[1], b[3] - b[1])))


def _line_columns(piece: np.ndarray, words: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Of whole pieces (numbered 0, 1, ... by ``piece``): each line's piece, its number from 1 and LINE_TYPE's columns, from the top
    and then from the left."""
    x, y, w, h, index = (words[c].to_numpy() for c in ("x", "y", "w", "h", "word_index"))
    x, y, w, h = (c.astype(np.int64) if c.dtype.kind in "iu" else c for c in (x, y, w, h))
    order = np.lexsort((index, x + w / 2, y + h / 2, piece))
    piece, x, y, h = piece[order], x[order], y[order], h[order]
    x2, y2, centre = x + w[order], y + h, x + w[order] / 2
    n = len(order)
    # strips: no word reaches over the next one's top
    low, least = y + np.maximum(h, 1), y.min()
    base = piece * (low.max() - least + 1) - least
    down = np.lexsort((y, piece))
    begins = np.ones(n, bool)
    begins[1:] = (y + base)[down][1:] >= np.maximum.accumulate((low + base)[down])[:-1]
    strip = np.empty(n, np.int64)
    strip[down] = np.cumsum(begins) - 1
    rows = np.argsort(strip, kind="stable")
    starts = np.flatnonzero(_first(strip[rows]))
    sizes = _sizes(starts, n)
    placed = _placed_words(x[rows], y[rows], x2[rows], y2[rows], starts, sizes)
    # a line goes by the place of its first word, its parts by that and which part they are
    line = np.repeat(starts, sizes) + placed
    members = np.argsort(line, kind="stable")
    starts = np.flatnonzero(_first(line[members]))
    sizes = _sizes(starts, n)
    members = rows[members]
    part = np.repeat(4 * members[starts], sizes)
    promo = pc.fill_null(words["promo"], False).to_numpy(zero_copy_only=False)[order][members]
    many = np.flatnonzero(sizes >= 6)  # fewer have no split
    for i in many:
        own = slice(starts[i], starts[i] + sizes[i])
        m = members[own]
        left = _columns_of(centre[m].tolist(), int(x[m].min()), int(x2[m].max()))
        if left is not None:
            part[own] += 2 * ~np.array(left)
    if promo.any():
        shown = np.zeros(n + 1, np.int64)
        np.cumsum(promo, out=shown[1:])
        held = shown[starts + sizes] - shown[starts]
        for i in np.flatnonzero((held > 0) & (held < sizes)):
            own = np.arange(starts[i], starts[i] + sizes[i])
            for side in (own[part[own] % 4 == 0], own[part[own] % 4 == 2]):
                is_promo, m = promo[side], members[side]
                if is_promo.any() and not is_promo.all() and _badges_apart(np.stack([x[m], y[m], x2[m], y2[m]], 1), is_promo):
                    part[side] += is_promo
    arranged = np.lexsort((members, x[members], part))
    members, part = members[arranged], part[arranged]
    starts = np.flatnonzero(_first(part))
    sizes = _sizes(starts, n)
    x1, y1, x2, y2 = np.minimum.reduceat(x[members], starts), np.minimum.reduceat(y[members], starts), np.maximum.reduceat(x2[members], starts), np.maximum.reduceat(y2[members], starts)
    piece = piece[members[starts]]
    by = np.lexsort((part[starts], x1, (y1 + y2) / 2, piece))
    piece, x1, y1, x2, y2, starts, sizes = (c[by] for c in (piece, x1, y1, x2, y2, starts, sizes))
    members = order[members[np.repeat(starts, sizes) + _within(sizes)]]
    starts = np.cumsum(sizes) - sizes
    number = _within(_sizes(np.flatnonzero(_first(piece)), len(piece))) + 1
    text = _joined(words["text"], members, starts, " ")
    mean = _means(words["confidence"].to_numpy()[members], starts, sizes)
    box = [pa.array(c, pa.int32()) for c in (x1, y1, x2 - x1, y2 - y1)]
    return piece, number, [text, *box, pa.array(mean, pa.float64()), _lists(words["word_index"].take(pa.array(members)).cast(pa.int32()), starts)]


def _pieces(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least: int = BATCH_WORDS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole pieces of a stream in which their rows follow one another, ``least`` rows or more at a time, and where they begin."""
    held, n, enough = [], 0, least
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= enough:
            whole = _one(held)
            begins = _begins(whole, keys)
            last = int(begins[-1])
            if last:
                yield whole.slice(0, last), begins[:-1]
                whole = whole.slice(last)
            held, n = [whole], whole.num_rows
            enough = max(least, 2 * n)
    if held:
        whole = _one(held)
        yield whole, _begins(whole, keys)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)], schema=batches[0].schema)


def _begins(rows: pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    n = rows.num_rows
    begins = np.zeros(n, bool)
    begins[0] = True
    for k in keys:
        other = pc.fill_null(pc.not_equal(rows[k].slice(1), rows[k].slice(0, n - 1)), True)
        begins[1:] |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(begins)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of rows with the same keys in a sorted stream, as columns; one run is held at a time."""
    key, held = None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = {c: batch[c].to_numpy().tolist() if pa.types.is_primitive(batch[c].type) and not batch[c].null_count and not pa.types.is_boolean(batch[c].type) else batch[c].to_pylist() for c in batch.schema.names}
        cuts = [*_begins(batch, keys).tolist(), n]
        for low, high in zip(cuts, cuts[1:], strict=False):
            mark = tuple(columns[k][low] for k in keys)
            if held is not None and mark == key:
                for c, v in columns.items():
                    held[c] += v[low:high]
            else:
                if held is not None:
                    yield key, held
                key, held = mark, {c: v[low:high] for c, v in columns.items()}
    if held is not None:
        yield key, held


def _array(values: tuple, type_: pa.DataType) -> pa.Array:
    if pa.types.is_list(type_):
        offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(list(chain.from_iterable(values)), type_.value_type), type=type_)
    return pa.array(values, type_)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded size."""
    while part := list(islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _streamed(sorted_rows: DataFrame, work, type_: str) -> DataFrame:
    """``work(batches)`` makes rows of ``type_`` out of a task's sorted batches."""
    schema = to_arrow_schema(sorted_rows.sparkSession.createDataFrame([], type_).schema)
    return sorted_rows.mapInArrow(lambda batches: _batches(iter(work(batches)), schema), type_)


def _by_piece(rows: DataFrame, keys: tuple[str, ...], work, type_: str) -> DataFrame:
    """``work(rows, begins)`` makes columns of ``type_`` out of whole pieces; rows of a piece follow one another in one task."""
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], type_).schema)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, begins in _pieces(batches, keys):
            out = pa.RecordBatch.from_arrays(work(whole, begins), schema=schema)
            yield from (out.slice(at, BATCH_ROWS) for at in range(0, out.num_rows, BATCH_ROWS))

    return rows.mapInArrow(made, type_)


def _types(df: DataFrame, columns: tuple[str, ...]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def bundles(words: DataFrame, keys: tuple[str, ...] = KEYS, size: int = BUNDLE_WORDS) -> DataFrame:
    """Words with ``bundle``: strips of the piece, from the top, until they have ``size`` words.

    A strip ends where no word reaches over the next one's top; a word without height counts as one high, so that words
    of one centre never part.  Tops are counted before the window, and only the tops of pieces with several bundles
    are joined back.
    """
    tops = words.groupBy(*keys, "y").agg(F.max(F.col("y") + F.greatest("h", F.lit(1))).alias("low"), F.count("*").alias("n"))
    above = W.partitionBy(*keys).orderBy("y").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*keys).orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    counted = tops.withColumns({"reach": F.max("low").over(above), "before": F.coalesce(F.sum("n").over(above), F.lit(0))})
    begin = F.when(F.col("reach").isNull() | (F.col("y") >= F.col("reach")), F.col("before"))
    numbered = counted.withColumn("bundle", F.floor(F.max(begin).over(upto) / size).cast("int")).where("bundle > 0").select(*keys, "y", "bundle")
    return words.join(numbered.hint("shuffle_hash"), [*keys, "y"], "left").withColumn("bundle", F.coalesce("bundle", F.lit(0)))


def group_lines(words: DataFrame, keys: tuple[str, ...] = KEYS, size: int = BUNDLE_WORDS, most: int = LONG_PIECE, together: bool = False) -> DataFrame:
    """``words(*keys, word_index, text, x, y, w, h, confidence)`` -> ``*keys, line, text, x, y, w, h, confidence, words, role``.

    Words go, from the top, to the open line that they fit best; lines are parted at wide column gaps and before
    promotional words that stand apart.  Pieces of more than ``most`` words are placed in bundles of ``size``.  Words of
    which a piece's follow one another in one task (``together``, for pieces of up to ``most``) do not move.
    """
    short, long = _short_and_long(words, keys, most, together)
    made = _lines_of_pieces(short, keys, together)
    return made if long is None else made.unionByName(_lines_of_bundles(long, keys, size))


def _short_and_long(words: DataFrame, keys: tuple[str, ...], most: int, together: bool) -> tuple[DataFrame, DataFrame | None]:
    """Words of pieces of up to ``most`` words, and of others if there are any."""
    needed = words.select(*keys, "word_index", "text", "x", "y", "w", "h", "confidence")
    if together:
        return needed, None
    # fewer than one in LONG_PIECE words, so their keys may be broadcast
    long = written(needed.groupBy(*keys).count().where(F.col("count") > most).select(*keys))
    if long.isEmpty():
        return needed, None
    return needed.join(F.broadcast(long), [*keys], "left_anti"), needed.join(F.broadcast(long), [*keys], "left_semi")


def _placed_lines(dealt: DataFrame, by: tuple[str, ...], number: str, together: bool = False) -> DataFrame:
    """The lines of each group of words, numbered from 1; words that lie ``together`` by their group stay where they are."""
    placed = dealt if together else dealt.repartition(*by).sortWithinPartitions(*by)
    # the role of a single word matters where it may be a badge only
    placed = placed.withColumn("promo", F.when(is_badge(F.col("text")), text_role(F.col("text")) == "promo_badge").otherwise(False))

    def work(rows: pa.RecordBatch, begins: np.ndarray) -> list[pa.Array]:
        piece, numbers, made = _line_columns(np.repeat(np.arange(len(begins)), _sizes(begins, rows.num_rows)), rows)
        return [*(rows[k].take(pa.array(begins[piece])) for k in by), pa.array(numbers, pa.int32()), *made]

    return _by_piece(placed, by, work, f"{_types(dealt, by)}, {number} int, {LINE_TYPE}")


def _lines_of_pieces(words: DataFrame, keys: tuple[str, ...], together: bool = False) -> DataFrame:
    return _placed_lines(words, keys, "line", together).withColumn("role", text_role(F.col("text")))


def _lines_of_bundles(words: DataFrame, keys: tuple[str, ...], size: int) -> DataFrame:
    made = _placed_lines(bundles(words, keys, size), (*keys, "bundle"), "place")
    line = F.row_number().over(W.partitionBy(*keys).orderBy("bundle", "place"))
    return made.select(*keys, line.alias("line"), "text", "x", "y", "w", "h", "confidence", "words", text_role(F.col("text")).alias("role"))


def _akin(own: str, role: str) -> bool:
    """Whether a line of ``role`` may go on with a micro-block of ``own``."""
    if own in ALONE or role in ALONE or {own, role} == {"campaign", "date_range"} or (own == "brand") != (role == "brand"):
        return False
    return (own != "description" or role in ("description", "unknown")) and (role != "description" or own in ("description", "unknown"))


class _Micro:
    """A micro-block that lines may still join."""

    def __init__(self, first: int, nth: int, line: int, text: str, x: int, y: int, w: int, h: int, confidence: float, words: list[int], role: str):
        self.place, self.role = (first, nth), role
        self.x1, self.y1, self.x2, self.y2, self.low, self.high = x, y, x + w, y + h, y + h, h
        self.lines, self.texts, self.confidences, self.words = [line], [text], [confidence], list(words)

    def add(self, line: int, text: str, x: int, y: int, w: int, h: int, confidence: float, words: list[int], role: str) -> bool:
        """Takes a line that goes on with this micro-block."""
        own = self.role
        if not _akin(own, role) or y - self.low > MICRO_GAP * max(8.0, (h + self.high) / 2):
            return False
        over = _share(self.x1, self.x2, x, x + w)
        if over < MICRO_OVERLAP and (over < ALIGNED_OVERLAP or abs(self.x1 - x) / max(1, min(self.x2 - self.x1, w)) > ALIGNED):
            return False
        self.lines.append(line)
        self.texts.append(text)
        self.confidences.append(confidence)
        self.words += words
        self.x1, self.y1, self.x2, self.y2 = min(self.x1, x), min(self.y1, y), max(self.x2, x + w), max(self.y2, y + h)
        self.low, self.high = y + h, h
        if own in ("unknown", "description") and role != "unknown":
            self.role = role
        return True

    def row(self) -> tuple:
        text = "\n".join(self.texts).strip() if len(self.texts) > 1 else self.texts[0].strip()
        return self.role, text, self.x1, self.y1, self.x2 - self.x1, self.y2 - self.y1, sum(self.confidences) / len(self.confidences), self.lines, self.words


def zoned(lines: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Lines with ``zone``: halves and quarters of the piece where lines leave wide gaps, and of these once more."""
    macro = macro_zones_windowed(lines, keys, *MACRO_SHARES, "Z_").withColumnRenamed("zone", "macro")
    return macro_zones_windowed(macro, (*keys, "macro"), *SUB_SHARES, "S_").withColumn("zone", F.concat_ws("|", "macro", "zone")).drop("macro")


def group_micro_blocks(lines: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Lines into micro-blocks inside zones of zones; ``block`` numbers the neighbours of one kind that belong together.

    Two streams: a zone's lines from the top, with the open micro-block, and a piece's micro-blocks from the top, with
    the open block's edges.
    """
    needed = lines.select(*keys, "line", "text", "x", "y", "w", "h", "confidence", "words", "role").repartition(*keys)
    zone = W.partitionBy(*keys, "zone")
    ranked = zoned(needed, keys).withColumn("first", F.min("line").over(zone))
    within = ranked.withColumn("nth", F.row_number().over(zone.orderBy("cy", "x", "line"))).sortWithinPartitions(*keys, "zone", "nth")

    columns = ("line", "text", "x", "y", "w", "h", "confidence", "words", "role")

    def micros(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        mark, held = None, None
        for batch in batches:
            marks, places = (zip(*(batch[c].to_pylist() for c in names), strict=True) for names in ((*keys, "zone"), ("first", "nth")))
            for of, place, line in zip(marks, places, zip(*(batch[c].to_pylist() for c in columns), strict=True), strict=True):
                if held is not None and of == mark and held.add(*line):
                    continue
                if held is not None:
                    yield (*mark[:-1], *held.place, mark[-1], *held.row())
                mark, held = of, _Micro(*place, *line)
        if held is not None:
            yield (*mark[:-1], *held.place, mark[-1], *held.row())

    made = _streamed(within, micros, f"{_types(lines, keys)}, first int, nth int, {MICRO_TYPE}")
    order = W.partitionBy(*keys).orderBy(F.col("y") + F.col("h") / F.lit(2.0), "x", "first", "nth")
    numbered = made.repartition(*keys).withColumn("micro", F.row_number().over(order)).sortWithinPartitions(*keys, "micro").drop("first", "nth")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, block, kind, box = None, 0, None, None
        for batch in batches:
            out = []
            for of, own, x1, y1, w, h in zip(zip(*(batch[k].to_pylist() for k in keys), strict=True), zip(batch["zone"].to_pylist(), batch["role"].to_pylist(), strict=True), *(batch[c].to_pylist() for c in "xywh"), strict=True):
                x2, y2 = x1 + w, y1 + h
                if of != mark:
                    mark, block, kind = of, 0, None
                joins = own == kind and own[1] in JOINABLE
                if joins:
                    joins = y1 - box[3] <= BLOCK_GAP * max(8.0, (box[3] - box[1] + h) / 2) and _share(box[0], box[2], x1, x2) >= BLOCK_OVERLAP
                if joins:
                    box = (min(box[0], x1), min(box[1], y1), max(box[2], x2), max(box[3], y2))
                else:
                    block, kind, box = block + 1, own, (x1, y1, x2, y2)
                out.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "block"])

    told = numbered.mapInArrow(blocks, f"{_types(numbered, tuple(numbered.columns))}, block int")
    return told.select(*keys, "micro", "block", *[part.split()[0] for part in MICRO_TYPE.split(", ")])


def block_rollup(micros: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``*keys, block, role, text, x, y, w, h, confidence, words``; confidence is the pairwise mean in order."""
    member = F.struct("micro", "text", "confidence", "words")
    parts = F.array_sort(F.collect_list(member))
    out = micros.groupBy(*keys, "block").agg(parts.alias("p"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))
    text = F.array_join(F.transform("p", lambda m: m["text"]), "\n")
    rest = F.slice("p", F.lit(2), F.size("p"))
    conf = F.aggregate(rest, F.get("p", F.lit(0))["confidence"], lambda s, m: (s + m["confidence"]) / 2.0)
    out = out.select(*keys, "block", text.alias("text"), "x", "y", "w", "h", F.bround(conf, 4).alias("confidence"), F.flatten(F.transform("p", lambda m: m["words"])).alias("words"))
    return out.withColumn("role", text_role(F.col("text")))


class _Simple:
    """A block that lines may still join."""

    def __init__(self, block: int):
        self.block, self.texts, self.confidences, self.lines, self.words = block, [], [], [], []
        self.x1 = self.y1 = float("inf")
        self.x2 = self.y2 = float("-inf")

    def add(self, line: int, text: str, x: int, y: int, w: int, h: int, confidence: float, words: list[int]) -> None:
        self.texts.append(text)
        self.confidences.append(confidence)
        self.lines.append(line)
        self.words += words
        self.x1, self.y1, self.x2, self.y2 = min(self.x1, x), min(self.y1, y), max(self.x2, x + w), max(self.y2, y + h)
        self.last, self.low, self.high = (x, w), y + h, h

    def takes(self, x: int, y: int, w: int, h: int) -> bool:
        if y - self.low > SIMPLE_GAP * max(8.0, (h + self.high) / 2):
            return False
        lx, lw = self.last
        by_last, by_block = _share(lx, lx + lw, x, x + w), _share(self.x1, self.x2, x, x + w)
        far = abs(x + w / 2 - lx - lw / 2) > max(lw, w) * SIMPLE_APART[0] and max(by_last, by_block) < SIMPLE_APART[1]
        return not far and (by_last >= SIMPLE_LAST or by_block >= SIMPLE_BLOCK)

    def closed(self, top: int | None, lift: float | None) -> bool:
        """No later line stands near enough: all begin at ``top`` or below, and none reaches above ``lift`` by its height."""
        return top is None or (top - self.low > SIMPLE_GAP * 8 + 1 and lift - self.low - SIMPLE_GAP / 2 * self.high > 1)

    def row(self) -> tuple:
        mean = sum(self.confidences) / len(self.confidences)
        return self.block, "\n".join(self.texts).strip(), self.x1, self.y1, self.x2 - self.x1, self.y2 - self.y1, mean, self.lines, self.words


def _simple_blocks(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The number, from 0, of each line's block in a piece: as ``_Simple`` takes lines, where a share that is enough is never far."""
    lift = y - SIMPLE_GAP / 2 * h
    tops, lifts = (np.append(np.minimum.accumulate(c[::-1])[::-1], np.inf)[1:].tolist() for c in (y, lift))
    numbers: list[int] = []
    still_open: list[list] = []
    made = 0
    for x1, y1, wide, high, top, lift in zip(x.tolist(), y.tolist(), w.tolist(), h.tolist(), tops, lifts, strict=True):
        x2 = x1 + wide
        for block in still_open:
            a1, a2, low, last_high, l1, l2, number = block
            if y1 - low > SIMPLE_GAP * max(8.0, (high + last_high) / 2):
                continue
            if (min(l2, x2) - max(l1, x1)) / max(1, min(l2 - l1, wide)) >= SIMPLE_LAST or (min(a2, x2) - max(a1, x1)) / max(1, min(a2 - a1, wide)) >= SIMPLE_BLOCK:
                block[:6] = a1 if a1 < x1 else x1, a2 if a2 > x2 else x2, y1 + high, high, x1, x2
                break
        else:
            number = made
            made += 1
            still_open.append([x1, x2, y1 + high, high, x1, x2, number])
            # blocks that no later line stands near
            still_open = [b for b in still_open if top - b[2] <= SIMPLE_GAP * 8 + 1 or lift - b[2] - SIMPLE_GAP / 2 * b[3] <= 1]
        numbers.append(number)
    return np.array(numbers)


def _simple_columns(begins: np.ndarray, lines: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
    """Of whole pieces' lines, in order: each simple block's piece and its columns."""
    x, y, w, h = (lines[c].to_numpy().astype(np.int64) for c in "xywh")
    n = len(x)
    sizes = _sizes(begins, n)
    number = np.concatenate([_simple_blocks(*(c[b : b + k] for c in (x, y, w, h))) for b, k in zip(begins.tolist(), sizes.tolist(), strict=True)])
    piece = np.repeat(np.arange(len(begins)), sizes)
    rows = np.lexsort((number, piece))
    starts = np.flatnonzero(_first(piece[rows]) | _first(number[rows]))
    x1, y1, x2, y2 = (f.reduceat(c[rows], starts) for f, c in ((np.minimum, x), (np.minimum, y), (np.maximum, x + w), (np.maximum, y + h)))
    mean = _means(lines["confidence"].to_numpy()[rows], starts, _sizes(starts, n))
    numbers = [pa.array(c, pa.int32()) for c in (number[rows[starts]] + 1, x1, y1, x2 - x1, y2 - y1)]
    members = _lists(lines["line"].take(pa.array(rows)), starts)
    return piece[rows[starts]], [numbers[0], _joined(lines["text"], rows, starts, "\n"), *numbers[1:], pa.array(mean, pa.float64()), members, _taken(lines["words"], rows, starts)]


def group_blocks_simple(lines: DataFrame, together: bool = False) -> DataFrame:
    """Lines, in order, to the first block that they follow closely enough: ``asset_id, block, text, x, y, w, h, confidence,
    lines, words``; without roles or zones.

    A stream of a piece's lines, with the blocks that a later line may still join: what later lines reach is known from
    running minima, so a line is compared with near blocks only.  Lines that lie ``together``, as ``group_lines`` leaves
    those of such words, do not move.
    """
    type_ = f"{_types(lines, KEYS)}, block int, text string, x int, y int, w int, h int, confidence double, lines array<int>, words array<int>"
    if together:

        def columns_of(rows: pa.RecordBatch, begins: np.ndarray) -> list[pa.Array]:
            piece, made = _simple_columns(begins, rows)
            return [rows["asset_id"].take(pa.array(begins[piece])), *made]

        return _by_piece(lines.select("asset_id", "line", "text", "x", "y", "w", "h", "confidence", "words"), KEYS, columns_of, type_)
    later = W.partitionBy("asset_id").orderBy(F.desc("line")).rowsBetween(W.unboundedPreceding, -1)
    needed = lines.select("asset_id", "line", "text", "x", "y", "w", "h", "confidence", "words").repartition("asset_id")
    bounded = needed.withColumns({"top": F.min("y").over(later), "lift": F.min(F.col("y") - F.lit(SIMPLE_GAP / 2) * F.col("h")).over(later)}).sortWithinPartitions("asset_id", "line")
    columns = ("line", "text", "x", "y", "w", "h", "confidence", "words")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        piece, n, still_open = None, 0, []
        for batch in batches:
            for of, top, lift, line in zip(*(batch[c].to_pylist() for c in ("asset_id", "top", "lift")), zip(*(batch[c].to_pylist() for c in columns), strict=True), strict=True):
                if of != piece:
                    piece, n = of, 0
                taker = next((b for b in still_open if b.takes(*line[2:6])), None)
                if taker is None:
                    n += 1
                    taker = _Simple(n)
                    still_open.append(taker)
                taker.add(*line)
                left = []
                for b in still_open:
                    if b.closed(top, lift):
                        yield (of, *b.row())
                    else:
                        left.append(b)
                still_open = left

    return _streamed(bounded, work, type_)


def _shares(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """``_share`` in columns."""
    return np.maximum(0, np.minimum(a2, b2) - np.maximum(a1, b1)) / np.maximum(1, np.minimum(a2 - a1, b2 - b1))


def _split_side(group: np.ndarray, v: np.ndarray, low: np.ndarray, high: np.ndarray, share: float) -> np.ndarray:
    """Of values in groups (0, 1, ...): 0 where the group's widest gap is no split, 1 before it, 2 after it; as ``split_point``
    over the span from the lowest ``low`` to the highest ``high``."""
    order = np.lexsort((v, group))
    g, s = group[order], v[order]
    starts = np.flatnonzero(_first(g))
    sizes = _sizes(starts, len(g))
    gap = np.append(np.where(g[1:] == g[:-1], s[1:] - s[:-1], -1.0), -1.0)
    widest = np.maximum.reduceat(gap, starts)
    span = np.maximum.reduceat(high[order], starts) - np.minimum.reduceat(low[order], starts)
    own = np.repeat(np.arange(len(starts)), sizes)
    found = np.flatnonzero(gap == widest[own])
    at = found[_first(own[found])]
    upto = at - starts + 1
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = (sizes >= 6) & (upto >= 2) & (sizes - upto >= 2) & (span > 1e-6) & (widest / span >= share)
    middle = np.where(cut, (s[at] + s[np.minimum(at + 1, len(s) - 1)]) / 2.0, np.nan)
    side = np.empty(len(g), np.int64)
    side[order] = np.where(np.isnan(middle)[own], 0, np.where(s < middle[own], 1, 2))
    return side


def _zones(piece: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The zones of ``zoned`` of whole pieces, as numbers."""
    zone = piece
    for of_x, of_y in (MACRO_SHARES, SUB_SHARES):
        sides = 3 * _split_side(zone, y + h / 2.0, y, y + h, of_y) + _split_side(zone, x + w / 2.0, x, x + w, of_x)
        zone = np.unique(9 * zone + sides, return_inverse=True)[1]
    return zone


def _runs(near: np.ndarray, start, grow) -> np.ndarray:
    """Where groups of neighbours begin.  ``near[i]`` tells whether i goes on with i - 1 alone; from there ``grow(start(i - 1), j)``
    tells whether i, i + 1, ... go on with all before."""
    begins = np.ones(len(near), bool)
    after = 0
    for i in np.flatnonzero(near).tolist():
        if i < after:
            continue
        group, after = start(i - 1), i
        while after < len(near) and grow(group, after):
            begins[after] = False
            after += 1
        after += 1  # what did not go on is alone: the next is told by ``near``
    return begins


def _block_columns(piece: np.ndarray, lines: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Of whole pieces' lines: each block's piece, its number from 1, the columns of ``block_rollup`` and the role of its line, if it
    has one only: as ``group_micro_blocks`` has them."""
    number, x, y, w, h = (lines[c].to_numpy().astype(np.int64) for c in ("line", "x", "y", "w", "h"))
    zone = _zones(piece, x, y, w, h)
    order = np.lexsort((number, x, y + h / 2.0, zone))
    zone, piece, number, x, y, w, h = (c[order] for c in (zone, piece, number, x, y, w, h))
    x2, y2, n = x + w, y + h, len(order)
    named = lines["role"].dictionary_encode()
    roles, role = named.dictionary.to_pylist(), named.indices.to_numpy()[order]
    confidence = lines["confidence"].to_numpy()[order]
    # micro-blocks: neighbours in a zone
    zones = np.flatnonzero(_first(zone))
    of_zone = np.repeat(np.arange(len(zones)), _sizes(zones, n))
    akin = np.array([[_akin(a, b) for b in roles] for a in roles])
    before, after = slice(0, n - 1), slice(1, n)
    over = _shares(x[before], x2[before], x[after], x2[after])
    near = np.zeros(n, bool)
    near[1:] = (zone[1:] == zone[:-1]) & akin[role[before], role[after]] & (y[after] - y2[before] <= MICRO_GAP * np.maximum(8.0, (h[after] + h[before]) / 2))
    near[1:] &= (over >= MICRO_OVERLAP) | ((over >= ALIGNED_OVERLAP) & (np.abs(x[before] - x[after]) / np.maximum(1, np.minimum(w[before], w[after])) <= ALIGNED))
    line = lambda i: (0, "", int(x[i]), int(y[i]), int(w[i]), int(h[i]), 0.0, [], roles[role[i]])
    changed = {}

    def start(i: int) -> _Micro:
        changed[i] = _Micro(0, 0, *line(i))
        return changed[i]

    begins = np.flatnonzero(_runs(near, start, lambda micro, j: zone[j] == zone[j - 1] and micro.add(*line(j))))
    sizes = _sizes(begins, n)
    kinds = {r: i for i, r in enumerate(roles)}
    kind = role.astype(np.int64)
    for i, micro in changed.items():
        kind[i] = kinds[micro.role]
    mean = _means(confidence, begins, sizes)
    edges = [f.reduceat(c, begins) for f, c in ((np.minimum, x), (np.minimum, y), (np.maximum, x2), (np.maximum, y2))]
    # blocks: neighbours of one zone and role in a piece
    first, nth = np.minimum.reduceat(number, zones)[of_zone[begins]], begins - zones[of_zone[begins]]
    by = np.lexsort((nth, first, edges[0], edges[1] + (edges[3] - edges[1]) / 2.0, piece[begins]))
    begins, sizes, mean = begins[by], sizes[by], mean[by]
    x1, y1, x2, y2 = (e[by] for e in edges)
    own, kind = zone[begins], kind[begins]
    joinable = np.array([r in JOINABLE for r in roles])[kind]
    near = np.zeros(len(by), bool)
    near[1:] = (own[1:] == own[:-1]) & (kind[1:] == kind[:-1]) & joinable[1:] & (y1[1:] - y2[:-1] <= BLOCK_GAP * np.maximum(8.0, (y2[:-1] - y1[:-1] + y2[1:] - y1[1:]) / 2))
    near[1:] &= _shares(x1[:-1], x2[:-1], x1[1:], x2[1:]) >= BLOCK_OVERLAP
    grown = lambda j: [int(x1[j]), int(y1[j]), int(x2[j]), int(y2[j])]

    def grow(box: list[int], j: int) -> bool:
        if own[j] != own[j - 1] or kind[j] != kind[j - 1]:
            return False
        a1, b1, a2, b2 = grown(j)
        if b1 - box[3] > BLOCK_GAP * max(8.0, (box[3] - box[1] + b2 - b1) / 2) or _share(box[0], box[2], a1, a2) < BLOCK_OVERLAP:
            return False
        box[:] = min(box[0], a1), min(box[1], b1), max(box[2], a2), max(box[3], b2)
        return True

    micros = np.flatnonzero(_runs(near, grown, grow))
    held = _sizes(micros, len(by))
    rows = order[np.repeat(begins, sizes) + _within(sizes)]
    of_micro = np.cumsum(sizes) - sizes
    at = of_micro[micros]
    many = np.flatnonzero(_sizes(at, n) > 1)
    text, role_of = lines["text"].take(pa.array(rows[at])), lines["role"].take(pa.array(rows[at]))
    whole, confidences = [], mean[micros]
    for b in many.tolist():
        parts = range(micros[b], micros[b] + held[b])
        texts = ["\n".join(lines["text"].take(pa.array(rows[of_micro[m] : of_micro[m] + sizes[m]])).to_pylist()).strip() for m in parts]
        whole.append("\n".join(texts))
        for m in parts[1:]:
            confidences[b] = (confidences[b] + mean[m]) / 2.0
    text, role_of = _replaced(text, many, whole), _replaced(role_of, many, [None] * len(many))
    box = [f.reduceat(c, micros) for f, c in ((np.minimum, x1), (np.minimum, y1), (np.maximum, x2), (np.maximum, y2))]
    of = piece[begins[micros]]
    number = _within(_sizes(np.flatnonzero(_first(of)), len(of))) + 1
    size = [pa.array(c, pa.int32()) for c in (box[0], box[1], box[2] - box[0], box[3] - box[1])]
    return of, number, [text, *size, pa.array(confidences, pa.float64()), _taken(lines["words"], rows, at), role_of]


def _taken(lists: pa.Array, rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The lists of groups of ``rows``, one after another."""
    taken = lists.take(pa.array(rows))
    ends = taken.offsets.to_numpy()
    return _lists(taken.flatten(), (ends - ends[0])[starts])


def _blocks_of_pieces(lines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``build_layout`` of lines as ``_lines_of_pieces`` leaves them, a piece's in one task and in order: no exchange."""

    def work(rows: pa.RecordBatch, begins: np.ndarray) -> list[pa.Array]:
        piece, numbers, made = _block_columns(np.repeat(np.arange(len(begins)), _sizes(begins, rows.num_rows)), rows)
        return [*(rows[k].take(pa.array(begins[piece])) for k in keys), pa.array(numbers, pa.int32()), *made]

    columns = f"{_types(lines, keys)}, block int, text string, x int, y int, w int, h int, confidence double, words array<int>, own string"
    made = _by_piece(lines, keys, work, columns).withColumn("confidence", F.bround("confidence", 4))
    return made.withColumn("role", F.coalesce("own", text_role(F.col("text")))).drop("own")


def _rolled(micros: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``block_rollup`` of micro-blocks as ``group_micro_blocks`` leaves them, a piece's in one task and in order: a stream with
    the open block, no exchange."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in batches:
            marks = zip(*(batch[k].to_pylist() for k in (*keys, "block")), strict=True)
            for mark, text, confidence, own, x, y, w, h in zip(marks, *(batch[c].to_pylist() for c in ("text", "confidence", "words", *"xywh")), strict=True):
                if held is not None and mark == held[0]:
                    _, texts, mean, words, x1, y1, x2, y2 = held
                    texts.append(text)
                    words += own
                    held = mark, texts, (mean + confidence) / 2.0, words, min(x1, x), min(y1, y), max(x2, x + w), max(y2, y + h)
                else:
                    if held is not None:
                        yield row(*held)
                    held = mark, [text], confidence, own, x, y, x + w, y + h
        if held is not None:
            yield row(*held)

    def row(mark, texts, mean, words, x1, y1, x2, y2) -> tuple:
        return (*mark, "\n".join(texts), x1, y1, x2 - x1, y2 - y1, mean, words)

    made = _streamed(micros, work, f"{_types(micros, keys)}, block int, text string, x int, y int, w int, h int, confidence double, words array<int>")
    return made.withColumn("confidence", F.bround("confidence", 4)).withColumn("role", text_role(F.col("text")))


def build_layout(words: DataFrame, keys: tuple[str, ...] = KEYS, most: int = LONG_PIECE, together: bool = False) -> DataFrame:
    """Words to blocks in one go; ``most`` and ``together`` as in ``group_lines``.  Pieces of up to ``most`` words move once at most."""
    short, long = _short_and_long(words, keys, most, together)
    made = _blocks_of_pieces(_lines_of_pieces(short, keys, together), keys)
    return made if long is None else made.unionByName(_rolled(group_micro_blocks(_lines_of_bundles(long, keys, BUNDLE_WORDS), keys), keys))
