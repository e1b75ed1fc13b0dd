"""Quality rules with line sequence labelling.

A linear-chain conditional random field labels every line of a document as content or boilerplate; Viterbi decoding
finds the best labelling, and the share of content decides retention, after two fixed base rules.  The labels of lines
are latent: only documents have quality labels, and each line shows its own label through its document's with a known
error.  The field is trained piecewise on a bounded sample of documents: first what a line's features say, by the
likelihood of what the documents show, then the moves between neighbours, by expectations over whole documents.  So good
documents may have boilerplate lines and bad ones content, and the moves between both are learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents of either class used for fitting, and the most lines of such a document: together they bound what
#: the driver gets.  Content share that a document needs.
SAMPLE_DOCS, SAMPLE_LINES = 1000, 100
MIN_SHARE = 0.5
#: Share of lines whose own label is taken to differ from their document's.
LINE_NOISE = 0.15
#: Characters that count as symbols, and ASCII white space.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\r\x0b\x0c"
#: What the line features count: A-Z, a-z, digits, symbols.
KINDS = (bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", SYMBOLS.encode())
FEATURES = ("bias", "length", "short", "sentence_end", "capitals", "digits", "symbols", "exclamations", "bars", "seen_before", "repetition", "word_length", "no_word")
BOILERPLATE, CONTENT = 0, 1


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [t for t in text.split("\n") if t.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that stand twice or more in the text."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, window, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    hit = np.concatenate([times[window] > 1, [False, False]])
    return int((hit | np.roll(hit, 1) | np.roll(hit, 2)).sum())


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of FEATURES for each line of a text, and the lines' characters (0 for lines without a word)."""
    seen: set[str] = set()
    rows, weights = [], []
    for line in text.split("\n"):
        words = line.split()
        n = max(len(line), 1)
        raw = line.encode("utf-8", "surrogatepass")
        capitals, small, digits, symbols = (len(raw) - len(raw.translate(None, kind)) for kind in KINDS)
        rows.append(
            (
                1.0,
                min(len(words), 100) / 100,
                float(0 < len(words) < 5),
                float(line.rstrip()[-1:] in tuple(".!?…\"'")),
                capitals / max(capitals + small, 1),
                digits / n,
                symbols / n,
                min(1.0, 10 * line.count("!") / n),
                min(1.0, 10 * line.count("|") / n),
                float(bool(words) and line in seen),
                1 - len(set(words)) / max(len(words), 1) if words else 0.0,
                min(n / max(len(words), 1), 20) / 20,
                float(not words),
            )
        )
        seen.add(line)
        weights.append(len(line) if words else 0)
    return np.array(rows, np.float32), np.array(weights)


class Field:
    """Weights of a two-label linear-chain field: per label and feature, and per pair of neighbouring labels."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi: the labelling of the greatest score; on ties the line counts as content."""
        scores = x.astype(np.float64) @ self.emit.T
        (m00, m01), (m10, m11) = self.move.tolist()
        b, c = scores[0].tolist()
        back = []
        for e0, e1 in scores[1:].tolist():
            from_b, to_b = (b + m00, c + m10), (b + m01, c + m11)
            back.append((from_b[1] >= from_b[0], to_b[1] >= to_b[0]))
            b, c = max(from_b) + e0, max(to_b) + e1
        label = int(c >= b)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1])

    @staticmethod
    def fit(docs: list[np.ndarray], labels: list[int], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3, noise: float = LINE_NOISE, passes: int = 5) -> Field:
        """Piecewise: ``rounds`` gradient steps with adapted rates for the features, then ``passes`` of forward-backward
        over all documents at once for the moves.  Without documents of both kinds all is content."""
        emit, move = np.zeros((2, len(FEATURES))), np.zeros((2, 2))
        if not docs or len(set(labels)) < 2:
            emit[CONTENT, 0] = 1.0
            return Field(emit, move)
        lines, shown = np.concatenate(docs).astype(np.float64), np.repeat(labels, [len(d) for d in docs])
        w, first, second = np.zeros(len(FEATURES)), np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
        for t in range(1, rounds + 1):
            free = 1 / (1 + np.exp(-np.clip(lines @ w, -35, 35)))
            right, wrong = np.where(shown == CONTENT, 1 - noise, noise), np.where(shown == CONTENT, noise, 1 - noise)
            given = free * right / (free * right + (1 - free) * wrong)
            g = (given - free) @ lines / len(lines) - decay * w
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w += rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        emit[CONTENT] = w
        most = max(map(len, docs))
        s, on = np.zeros((len(docs), most, 2)), np.zeros((len(docs), most), bool)
        for i, d in enumerate(docs):
            s[i, : len(d)], on[i, : len(d)] = d @ emit.T, True
        for _ in range(passes):
            _, pairs = expectations(s, move, on)
            pairs = (pairs + 1) / (pairs + 1).sum()
            # how much oftener neighbours have these labels than if they had nothing to do with each other
            move = np.log(pairs / (pairs.sum(axis=1, keepdims=True) * pairs.sum(axis=0, keepdims=True)))
        return Field(emit, move)


def expectations(s: np.ndarray, move: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over documents of scored lines: the labels' marginals, and the expected moves in all."""
    most = s.shape[1]
    ahead, behind = np.zeros(s.shape), np.zeros(s.shape)
    ahead[:, 0] = s[:, 0]
    for k in range(1, most):
        new = np.logaddexp(ahead[:, k - 1, :1] + move[0], ahead[:, k - 1, 1:] + move[1]) + s[:, k]
        ahead[:, k] = np.where(on[:, k, None], new, ahead[:, k - 1])
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    for k in range(most - 2, -1, -1):
        after = s[:, k + 1] + behind[:, k + 1]
        new = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
        behind[:, k] = np.where(on[:, k + 1, None], new, 0)
    p = np.exp(ahead + behind - total[:, None, None]) * on[..., None]
    both = ahead[:, :-1, :, None] + move + (s[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
    return p, (np.exp(np.minimum(both, 0)) * on[:, 1:, None, None]).sum(axis=(0, 1))


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """Fit on at most SAMPLE_DOCS documents of either quality, those of the least hash, of at most SAMPLE_LINES lines."""
    rated = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    sample = None
    for quality in (0, 1):
        part = rated.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
        sample = part if sample is None else sample.union(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where(F.size(F.split("text", "\n")) <= SAMPLE_LINES).select("quality", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"quality": pdf["quality"], "x": [line_features(t or "")[0].tobytes() for t in pdf["text"]]})

    got = texts.mapInPandas(run, "quality int, x binary").toArrow()
    rows = [np.frombuffer(x.as_py(), np.float32).reshape(-1, len(FEATURES)) for x in got["x"]]
    return Field.fit(rows, got["quality"].to_pylist())


def judge(docs: DataFrame, field: Field) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    content_share, kept``, a row per input row.

    base_failed: fewer than 50 words, or more than half of the words repeated in three-word windows.  Otherwise kept
    says whether content lines hold at least MIN_SHARE of the characters.  Null counts as empty, which fails the base rules;
    repeated rows each get their row; on ties a line is content; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field.emit, field.move))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Field(*shared.value)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                text = text or ""
                counts = base_counts(text)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                x, weights = line_features(text)
                share = float(weights @ (own.decode(x) == CONTENT) / weights.sum()) if weights.sum() else 0.0
                rows.append((*counts, failed, share, not failed and share >= MIN_SHARE))
            out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    # ids go through as text where they may be null: pandas has no null long
    as_text = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = as_text.mapInPandas(run, "doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
