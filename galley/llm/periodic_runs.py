"""Periodic runs of words, found on a grammar of each document.

The word ids of a document are compressed by Re-Pair: pairs of neighbouring symbols that stand twice or more become
rules, the frequent and short ones first.  A run of words with period q lies inside some rule's words and goes across
the border between that rule's two parts; runs across a border are computed once for each rule, where it first stands,
and then carried to every place that the rule derives.  What a longer run contains is dropped, which leaves the maximal
intervals.  Spark deals out the documents; a task works on the words of some documents at a time with numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound

#: A run has at least so many words, and so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words that are worked on at a time (a longer document is a group of its own), and tests of a period at a border.
GROUP_WORDS, GROUP_TESTS = 400_000, 1_000_000
RESULT = "struct<runs:array<struct<start:int,length:int,period:int>>,kept:array<struct<start:int,length:int>>>"
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(values: np.ndarray) -> np.ndarray:
    """A fixed 64-bit hash of integers."""
    v = (values.astype(np.uint64) + np.uint64(1)) * _BASE
    v = (v ^ (v >> np.uint64(30))) * _MIX
    return v ^ (v >> np.uint64(27))


def grammar(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Re-Pair over the documents' words (``doc`` ascending): ``rule, start, middle, end`` of every place of every rule.

    A round replaces each repeated pair that ranks before the pairs on either side (of equal neighbours, as in
    ``aaa``, every second), so the rounds are few.  Pairs that stand once stay so and are not looked at again.  At last
    what is left of each document, where no pair repeats, is joined in halves by rules that stand once.
    """
    seq = np.unique(doc * (int(words.max()) + 1) + words, return_inverse=True)[1].astype(np.int64) if len(words) else words.astype(np.int64)
    n_symbols = int(seq.max()) + 1 if len(seq) else 0
    size, pos, span = np.ones(n_symbols, np.int64), np.arange(len(seq)), np.ones(len(seq), np.int64)
    live = doc[1:] == doc[:-1]
    found: list[tuple[np.ndarray, ...]] = []

    def join(hit: np.ndarray, rule: np.ndarray) -> None:
        nonlocal seq, pos, span
        ends = pos[hit + 1] + span[hit + 1]
        found.append((rule, pos[hit], pos[hit + 1], ends))
        seq[hit], span[hit] = rule, ends - pos[hit]
        stay = np.ones(len(seq), bool)
        stay[hit + 1] = False
        seq, pos, span = seq[stay], pos[stay], span[stay]

    while len(at := np.flatnonzero(live)):
        pairs, which, times = np.unique(seq[at] * n_symbols + seq[at + 1], return_inverse=True, return_counts=True)
        often = times[which] > 1
        live[at[~often]] = False
        at, which = at[often], which[often]
        if not len(at):
            break
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((_mixed(pairs), -(size[pairs // n_symbols] + size[pairs % n_symbols]), times))] = np.arange(1, len(pairs) + 1)
        here = np.zeros(len(seq) + 1, np.int64)
        here[at + 1] = rank[which]
        before, mine, after = here[at], here[at + 1], here[at + 2]
        turn = np.arange(len(at))
        even = (turn - np.maximum.accumulate(np.where(before != mine, turn, 0))) % 2 == 0
        take = (mine >= before) & (mine >= after) & even
        hit, (made, rule) = at[take], np.unique(which[take], return_inverse=True)
        size = np.concatenate([size, size[pairs[made] // n_symbols] + size[pairs[made] % n_symbols]])
        fresh = np.zeros(len(live), bool)  # beside a new symbol every pair is new
        fresh[hit[hit > 0] - 1] = fresh[hit[hit + 1 < len(live)] + 1] = True
        live = np.delete(live | fresh, hit)
        join(hit, rule + n_symbols)
        live &= doc[pos[1:]] == doc[pos[:-1]]
        n_symbols += len(made)
    while True:
        own = doc[pos]
        place = np.arange(len(pos))
        place -= np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]])[: len(pos)], place, 0))
        hit = np.flatnonzero((place[:-1] % 2 == 0) & (own[:-1] == own[1:]))
        if not len(hit):
            break
        join(hit, n_symbols + np.arange(len(hit)))
        n_symbols += len(hit)
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


class _Equal:
    """Whether stretches of words are equal, by sums of hashes."""

    def __init__(self, words: np.ndarray):
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _BASE | np.uint64(1), np.uint64)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(words) * self.power[:-1])])

    def __call__(self, a: np.ndarray, n: np.ndarray, shift: np.ndarray) -> np.ndarray:
        s = self.sums
        return (s[a + n] - s[a]) * self.power[shift] == s[a + shift + n] - s[a + shift]

    def reach(self, a: np.ndarray, most: np.ndarray, shift: np.ndarray, back: bool) -> np.ndarray:
        """How far from ``a`` words equal those ``shift`` later, up to ``most``, to the right or to the left."""
        low, high = np.zeros_like(most), most.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_] + 1) // 2
            ok = self(a[open_] - (mid if back else 0), mid, shift[open_])
            low[open_[ok]], high[open_[~ok]] = mid[ok], mid[~ok] - 1
        return low


def _tests(most: np.ndarray):
    """``(node, period)`` for every period from 1 to ``most`` of each node, in groups of bounded size."""
    total = np.concatenate([[0], np.cumsum(most)])
    for low in range(0, int(total[-1]), GROUP_TESTS):
        n = np.arange(low, min(low + GROUP_TESTS, int(total[-1])))
        node = np.searchsorted(total, n, "right") - 1
        yield node, n - total[node] + 1


def _verified(words: np.ndarray, start: np.ndarray, end: np.ndarray, found: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Rows ``node, first, last, period`` of the proposed runs that hold word by word, by their least periods only.

    Hashes never miss equal words but may take others for equal: such a run is measured again on the words.
    """
    node, at, first, last, q = (np.concatenate(part) for part in zip(*found, strict=True))
    order = np.lexsort((q, last, first, node))
    rows, known = [], None
    for n, a, s, e, p in zip(*(x[order].tolist() for x in (node, at, first, last, q)), strict=True):
        if known == (n, s, e):
            continue  # the same words by a multiple of their period
        if np.array_equal(words[s : e - p], words[s + p : e]):
            rows.append((n, s, e, p))
            known = (n, s, e)
        else:
            low, high = int(start[n]), int(end[n])
            odd = low + np.flatnonzero(words[low : high - p] != words[low + p : high])
            k = int(np.searchsorted(odd, a))
            s, e = (int(odd[k - 1]) + 1 if k else low), (int(odd[k]) if k < len(odd) else high - p) + p
            if e - s >= max(MIN_WORDS, MIN_PERIODS * p):
                rows.append((n, s, e, p))
    out = np.unique(np.array(rows, np.int64).reshape(-1, 4), axis=0)  # by node, first, last, period
    least = np.concatenate([[True], (out[1:, :3] != out[:-1, :3]).any(axis=1)])[: len(out)]
    return out[least]


def crossing_runs(words: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows ``node, first, last, period`` of the runs inside ``[start, end)`` that cross ``middle``, by their least periods.

    A run of four or more periods has two of them on one side of the border, so the periods to test are those up to
    half of either side; of these, the ones are left for which the words beside the border repeat.
    """
    equal, found = _Equal(words), [tuple(np.zeros(0, np.int64) for _ in range(5))]
    quarter = (end - start) // MIN_PERIODS
    for right in (True, False):
        for node, q in _tests(np.minimum((end - middle if right else middle - start) // 2, quarter)):
            at = middle[node] if right else middle[node] - q
            near = (words[at] == words[at + q]) & (words[at - 1] == words[at - 1 + q])
            node, q, at = node[near], q[near], at[near]
            twice = equal(at if right else at - q, q, q)
            node, q, at = node[twice], q[twice], at[twice]
            first = at - equal.reach(at, at - start[node], q, True)
            last = at + q + equal.reach(at, end[node] - q - at, q, False)
            long = last - first >= np.maximum(MIN_WORDS, MIN_PERIODS * q)
            found.append((node[long], at[long], first[long], last[long], q[long]))
    return _verified(words, start, end, found)


def find_runs(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows ``start, end, period`` (places in ``words``) of all runs, by start and period."""
    rule, start, middle, end = grammar(words, doc)
    large = end - start >= MIN_WORDS
    rule, start, middle, end = rule[large], start[large], middle[large], end[large]
    kinds, first, which = np.unique(rule, return_index=True, return_inverse=True)
    runs = crossing_runs(words, start[first], middle[first], end[first])
    # to every place of the rule
    by_rule = np.argsort(which, kind="stable")
    low = np.searchsorted(which[by_rule], runs[:, 0])
    times = np.searchsorted(which[by_rule], runs[:, 0], "right") - low
    run = np.repeat(np.arange(len(runs)), times)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
    shift = start[by_rule[low[run] + nth]] - start[first][runs[run, 0]]
    s, e, q = runs[run, 1] + shift, runs[run, 2] + shift, runs[run, 3]
    # of one period, what lies inside another goes
    order = np.lexsort((-e, s, q))
    s, e, q = s[order], e[order], q[order]
    reach = np.maximum.accumulate(np.concatenate([[0], q * (len(words) + 1) + e]))[:-1]
    whole = q * (len(words) + 1) + e > reach
    out = np.stack([s[whole], e[whole], q[whole]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _group(words: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For documents of these sizes, one after the other: columns of runs and of kept stretches, each with its document first."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.cumsum(sizes) - sizes
    runs = find_runs(words, doc)
    of = doc[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept = np.cumsum(gone)[:-1] == 0
    begins = kept & np.concatenate([[True], ~kept[:-1] | (doc[1:] != doc[:-1])])[: len(kept)]
    ends = kept & np.concatenate([~kept[1:] | (doc[1:] != doc[:-1]), [True]])[: len(kept)]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return [of, runs[:, 0] - offset[of], runs[:, 1] - runs[:, 0], runs[:, 2]], [doc[a], a - offset[doc[a]], b - a]


def _lists(parts: list[list[np.ndarray]], n: int, names: tuple[str, ...]) -> pa.ListArray:
    """Columns (document first, ascending) as one list of structs for each of ``n`` documents."""
    of, *columns = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (zip(*parts, strict=True) if parts else [[]] * (len(names) + 1)))
    offsets = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], list(names)))


def _analyse(texts: pa.Array) -> pa.Array:
    """An array of word lists -> RESULT for each."""
    sizes = np.diff(texts.offsets.to_numpy()).astype(np.int64)
    ids = texts.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    runs, kept, low = [], [], 0
    while low < len(sizes):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + GROUP_WORDS, "right")))
        one, rest = _group(ids[done : ends[high - 1]], sizes[low:high])
        one[0], rest[0] = one[0] + low, rest[0] + low
        runs.append(one)
        kept.append(rest)
        low = high
    columns = [_lists(runs, len(sizes), ("start", "length", "period")), _lists(kept, len(sizes), ("start", "length"))]
    return pa.StructArray.from_arrays(columns, ["runs", "kept"])


def words_of(text: Column) -> Column:
    """What ASCII white space parts; null has no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def runs_of(words: Column) -> Column:
    """``runs`` (start, length, period; by start and period) and ``kept`` (start, length) of an array of words.

    A run is a longest stretch in which words its smallest period apart are equal, of at least 6 words and 4 periods.
    Kept are the words that are in no run, or in the first period of every run that holds them.
    """
    return F.arrow_udf(_analyse, RESULT)(words)


def periodic_runs(docs: DataFrame, words: Column | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, words, runs, kept, collapsed``, a row per row; ``words`` may name other words than the text's.

    collapsed are the kept words joined by one space.  Null and empty texts have no words, no runs and an empty
    collapsed text; repeated rows each get their row; other columns are not looked at.
    """
    given = docs.select(F.col("doc_id").alias("doc_id"), (words_of(F.col("text")) if words is None else words).alias("words"))
    found = given.withColumn("found", runs_of(F.col("words")))
    parts = lambda ws: F.flatten(F.transform(F.col("found.kept"), lambda k: F.slice(ws, k["start"] + 1, k["length"])))
    return found.select("doc_id", "words", "found.runs", "found.kept", F.array_join(bound(F.col("words"), parts), " ").alias("collapsed"))


def planted_words(doc_id: Column, text: Column) -> Column:
    """The words of a text; for one id in ten (h % 10 = 0, where h is the unsigned crc32 of the id's decimals) periodic from
    word a on: a = g % n and p = 1 + (n - a) div (3 + g % 8), with g = h div 10."""
    h = F.coalesce(F.crc32(doc_id.cast("string")), F.lit(1))
    g = F.floor(h / 10)

    def repeat(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        periodic = bound(F.struct(a.alias("a"), p.alias("p")), lambda s: F.transform(ws, lambda w, i: F.when(i < s["a"], w).otherwise(F.get(ws, s["a"] + (i - s["a"]) % s["p"]))))
        return F.when((h % 10 == 0) & (n > 0), periodic).otherwise(ws)

    return bound(words_of(text), repeat)
