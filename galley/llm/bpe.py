"""Byte-level BPE encoding and decoding with DuckDB inside Spark tasks.

Spark deals out the documents; in each task a DuckDB session works on relations.  The distinct pieces of a group of
texts become token-position rows.  A recursive query joins neighbouring tokens to the merge table and contracts every
piece's leftmost pair of the least rank, all pieces at once, until no pair of any piece can merge.  Decoding joins ids
to the vocabulary and aggregates the bytes in position order.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pieces whose codes a worker keeps between groups; beyond it starts anew, so its memory is bounded.
CACHE_PIECES = 700_000
#: Texts are coded in groups of about this many characters, which bounds the relations of one recursive query.
GROUP_CHARS = 3_000_000
#: Vocabularies above this size are refused: the ranks are sent to every worker.
MAX_VOCABULARY = 1_000_000
#: Longer pieces (in bytes) take the query that contracts all occurrences of the least pair in one round, which gives
#: the same tokens for regular vocabularies (see ``Coder.regular``); for others no piece takes it.
LONG_PIECE = 120

#: Rows are tokens: the byte position where they start, where the next one starts, and their id.  ``rank << 32 | pos``
#: orders pairs by rank, then from the left; the second token of the contracted pair is dropped.  A piece that has no
#: pair left makes no further rows, so its last step is its result.
STEPS = """
WITH RECURSIVE state(step, piece, pos, next, id) AS (
    SELECT 0, piece, pos, pos + 1, id FROM start
  UNION ALL (
    WITH pairs AS MATERIALIZED (
      SELECT a.piece, a.next AS mid, b.next, (m.made::BIGINT << 32) + a.pos AS place
      FROM state a JOIN state b ON a.piece = b.piece AND a.next = b.pos JOIN merges m ON m.l = a.id AND m.r = b.id),
    best AS MATERIALIZED (
      SELECT piece, min(place) AS place, arg_min(mid, place) AS mid, arg_min(next, place) AS next FROM pairs GROUP BY piece)
    SELECT step + 1, s.piece, s.pos,
      CASE WHEN s.pos = (b.place & 4294967295) THEN b.next ELSE s.next END,
      CASE WHEN s.pos = (b.place & 4294967295) THEN (b.place >> 32)::INT ELSE s.id END
    FROM state s JOIN best b ON s.piece = b.piece WHERE s.pos <> b.mid)
)
"""
FIXPOINT = STEPS + "SELECT piece, pos, id FROM state QUALIFY step = max(step) OVER (PARTITION BY piece)"

#: The same, but a round contracts every occurrence of the piece's least rank; where occurrences overlap (``aaa``),
#: every second one from the left.  In a regular vocabulary a pair that a merge makes ranks after that merge, so the
#: leftmost least pair stays one of these occurrences until all are contracted, and the result is the same.
#: The state is keyed by place, so only the last round's tokens are held; a token that is merged into the one before it
#: stays as a row without id.
FIXPOINT_LONG = """
WITH RECURSIVE state(piece, pos, id) USING KEY (piece, pos) AS (
    SELECT piece, pos, id FROM start
  UNION
    SELECT piece, pos, CASE WHEN before IS NULL THEN coalesce(merged, id) END FROM (
      SELECT *, lag(merged) OVER (PARTITION BY piece ORDER BY pos) AS before FROM (
        SELECT *, CASE WHEN hit AND (place - min(place) OVER (PARTITION BY piece, hit, island)) % 2 = 0 THEN made END AS merged FROM (
          SELECT *, place - row_number() OVER (PARTITION BY piece, hit ORDER BY place) AS island FROM (
            SELECT *, made IS NOT NULL AND made = best AS hit FROM (
              SELECT s.*, m.made, min(m.made) OVER (PARTITION BY s.piece) AS best
              FROM (SELECT *, row_number() OVER w AS place, lead(id) OVER w AS next FROM recurring.state WHERE id IS NOT NULL WINDOW w AS (PARTITION BY piece ORDER BY pos)) s
              LEFT JOIN merges m ON m.l = s.id AND m.r = s.next)
            WHERE best IS NOT NULL)))) WHERE merged IS NOT NULL OR before IS NOT NULL
)
SELECT piece, pos, id FROM state WHERE id IS NOT NULL
"""

#: Ordered aggregation: a piece's ids, and the bytes that the vocabulary has for them.
COLLECT = "SELECT piece, list(s.id ORDER BY pos) AS ids, string_agg(v.token, '' ORDER BY pos) AS bytes FROM ({}) s JOIN vocabulary v ON v.id = s.id GROUP BY piece"


def load_ranks(spark: SparkSession, path: str) -> list[tuple[bytes, int]]:
    """The public rank file (base64 token, rank on each line); refused beyond MAX_VOCABULARY."""
    lines = spark.read.text(path).where("value <> ''")
    rows = lines.select(F.unbase64(F.substring_index("value", " ", 1)), F.substring_index("value", " ", -1).cast("int")).limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} tokens in {path}")
    return [(bytes(token), rank) for token, rank in rows]


class Coder:
    """A DuckDB session with the vocabulary and the merge table, and the codes of the pieces met so far."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str, long_piece: float = LONG_PIECE):
        import duckdb
        import regex

        self.split, self.long_piece = regex.compile(pattern).findall, long_piece
        self.ranks = dict(ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.codes: dict[str, tuple[bytes, bytes]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        given = pa.table({"token": [t.hex() for t, _ in ranks], "id": pa.array([r for _, r in ranks], pa.int32())})
        self.db.register("given", given)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.execute(
            """CREATE TABLE merges AS
            WITH cuts AS (SELECT token, id, unnest(range(2, length(token), 2)) AS width FROM vocabulary)
            SELECT a.id AS l, b.id AS r, c.id AS made FROM cuts c JOIN vocabulary a ON a.token = left(c.token, c.width) JOIN vocabulary b ON b.token = substr(c.token, c.width + 1)"""
        )

    def regular(self) -> bool:
        """Whether every token's own bytes contract to that token, by merges that rank before it.

        Then a pair that a merge makes always ranks after that merge: its bytes, between token ends, would have become
        one token before.  So one round may contract every occurrence of the least pair.
        """
        tokens = [t for t in self.ranks if len(t) > 1]
        piece = np.repeat(np.arange(len(tokens), dtype=np.int32), [len(t) for t in tokens])
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        self.db.register("start", pa.table({"piece": piece, "pos": np.arange(len(raw), dtype=np.int32), "id": self.byte_ids[raw]}))
        most = self.db.sql(STEPS + "SELECT piece, max(id) AS id FROM state GROUP BY piece ORDER BY piece").to_arrow_table()["id"].to_pylist()
        ends = self.db.execute(f"SELECT count(*) FROM ({FIXPOINT})").fetchone()[0]
        return ends == len(tokens) and most == [self.ranks[t] for t in tokens]

    def learn(self, pieces: list[str]) -> None:
        """Code new pieces by the recursive query; a piece that is a token by itself needs no contraction.

        What is decoded are always the ids: the bytes come from the vocabulary, not from the piece.
        """
        whole, short, long = [], [], []
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            (whole if raw in self.ranks else short if len(raw) <= self.long_piece else long).append((p, raw))
        for query, todo in (("SELECT * FROM start", whole), (FIXPOINT, short), (FIXPOINT_LONG, long)):
            if not todo:
                continue
            raws = [raw for _, raw in todo]
            if todo is whole:
                piece, ids = np.arange(len(raws), dtype=np.int32), np.array([self.ranks[raw] for raw in raws], np.int32)
            else:
                piece, ids = np.repeat(np.arange(len(raws), dtype=np.int32), [len(r) for r in raws]), self.byte_ids[np.frombuffer(b"".join(raws), np.uint8)]
            self.db.register("start", pa.table({"piece": piece, "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
            got = self.db.sql(COLLECT.format(query)).to_arrow_table()
            lists = got["ids"].combine_chunks()
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32).tobytes(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, (k, text) in enumerate(zip(got["piece"].to_pylist(), got["bytes"].to_pylist(), strict=True)):
                self.codes[todo[k][0]] = (flat[4 * at[i] : 4 * at[i + 1]], bytes.fromhex(text))

    def round_trip(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text the int32 ids, and the bytes that they decode to."""
        split = [self.split(t) for t in texts]
        wanted = set().union(*split)
        if len(self.codes) + len(wanted) > CACHE_PIECES:
            self.codes = {}
        self.learn([p for p in wanted if p not in self.codes])
        codes = self.codes
        out = []
        for pieces in split:
            got = [codes[p] for p in pieces]
            out.append((b"".join([c[0] for c in got]), b"".join([c[1] for c in got])))
        return out


@functools.lru_cache(maxsize=1)
def _coder(key: tuple) -> Coder:
    shared, pattern, long_piece = key
    return Coder(shared.value, pattern, long_piece)


@functools.lru_cache(maxsize=4)
def _regular(ranks: tuple[tuple[bytes, int], ...]) -> bool:
    """Checked once for a vocabulary, in the driver: its size is bounded by MAX_VOCABULARY, whatever the corpus."""
    coder = Coder(list(ranks), "")
    try:
        return coder.regular()
    finally:
        coder.db.close()


class _Key:
    """A broadcast with the identity of its content, so that a reused worker keeps its session."""

    def __init__(self, shared, name: str):
        self.shared, self.name = shared, name

    def __eq__(self, other) -> bool:
        return self.name == other.name

    def __hash__(self) -> int:
        return hash(self.name)

    @property
    def value(self):
        return self.shared.value


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """``docs(key, text)`` -> ``key, ids array<int>, decoded binary``, one row per input row.

    Every match of ``pattern`` is coded by itself, without special tokens; null texts count as empty and have no ids.
    Whole texts are coded, however long; repeated rows each get their own row.  ``keep`` leaves the session and the codes
    met so far with the worker for its next task; without it a worker's memory is free again for what runs after.
    """
    spark = docs.sparkSession
    ranks = load_ranks(spark, ranks_path)
    shared = _Key(spark.sparkContext.broadcast(ranks), ranks_path)
    long_piece = LONG_PIECE if _regular(tuple(ranks)) else float("inf")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = np.cumsum(pa.compute.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.flatnonzero(np.diff(sizes // GROUP_CHARS)) + 1
        for a, b in zip([0, *ends], [*ends, len(sizes)], strict=True):
            if b > a:
                yield batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder((shared, pattern, long_piece)) if keep else Coder(shared.value, pattern, long_piece)
        for batch in batches:
            for part in groups(batch):
                got = coder.round_trip(part["text"].to_pylist())
                offsets = np.cumsum([0, *(len(i) // 4 for i, _ in got)], dtype=np.int32)
                values = np.frombuffer(b"".join([i for i, _ in got]), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([part["key"], ids, pa.array([d for _, d in got], pa.binary())], ["key", "ids", "decoded"])
        if not keep:
            coder.db.close()
            coder.codes = {}
            pa.default_memory_pool().release_unused()

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", key)


def decode(tokens: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``tokens(key, ids array<int>)`` -> ``key, decoded binary``: ids joined to the vocabulary, bytes aggregated in order.

    Null or empty ids decode to no bytes; an id that is not in the vocabulary fails the job.
    """
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(load_ranks(spark, ranks_path))
    rows = tokens.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        db.register("vocabulary", pa.table({"token": [t.hex() for t, _ in shared.value], "id": pa.array([r for _, r in shared.value], pa.int32())}))
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                lists = part["ids"]
                db.register("given", pa.table({"n": lists.value_parent_indices() if hasattr(lists, "value_parent_indices") else pa.compute.list_parent_indices(lists), "pos": np.arange(len(lists.flatten())), "id": lists.flatten()}))
                missing = db.execute("SELECT count(*) FROM given ANTI JOIN vocabulary USING (id)").fetchone()[0]
                if missing:
                    raise ValueError(f"{missing} ids are not in the vocabulary")
                got = dict(db.execute("SELECT n, string_agg(token, '' ORDER BY pos) FROM given JOIN vocabulary USING (id) GROUP BY n").fetchall())
                yield pa.RecordBatch.from_arrays([part["key"], pa.array([bytes.fromhex(got.get(i, "")) for i in range(len(part))], pa.binary())], ["key", "decoded"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, decoded binary").withColumnRenamed("key", key)
