import base64
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from galley.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "Hello world, it's 2024!", "a" * 5000, "aaab" * 300, "été — ñandú 日本語 🙂", " \n\t  x\n\n", "=" * 500 + "abc" * 200, "<|endoftext|> plain", "x7Qz" * 120, "Hello world, it's 2024!"]


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library_and_exact_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in bpe.encode_decode(docs, PATH, P.PATTERN).collect()}
    enc = library()
    for i, t in enumerate(TEXTS):
        assert rows[i].ids == enc.encode_ordinary(t or ""), t
        assert bytes(rows[i].decoded) == (t or "").encode()


def test_decode_by_ordered_aggregation(spark):
    enc = library()
    tokens = spark.createDataFrame([(i, enc.encode_ordinary(t) if t is not None else None) for i, t in enumerate(TEXTS)], "doc_id long, ids array<int>")
    rows = {r.doc_id: bytes(r.decoded) for r in bpe.decode(tokens, PATH).collect()}
    assert rows == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0


def ranks_of_file():
    return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, open(PATH, "rb"))]


def test_what_is_decoded_are_the_ids():
    coder = bpe.Coder(ranks_of_file(), P.PATTERN)
    coder.db.execute(f"UPDATE vocabulary SET token = '{b' WORLD'.hex()}' WHERE token = '{b' world'.hex()}'")
    coder.db.execute(f"UPDATE vocabulary SET token = '{b'+'.hex()}' WHERE token = '{b'x'.hex()}'")
    (ids, decoded), (_, other) = coder.round_trip(["Hello world", "x7Qz" * 3])
    assert ids == np.array(library().encode_ordinary("Hello world"), np.int32).tobytes()
    assert decoded == b"Hello WORLD" and b"+" in other


def test_an_irregular_vocabulary_contracts_one_pair_a_round():
    """``aba`` ranks before ``ab``, of which it is made."""
    ranks = [(bytes([b]), b) for b in range(256)] + [(b"ba", 400), (b"ab", 300), (b"aba", 299)]
    text = "ab" * 100
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})
    assert not bpe._regular(tuple(ranks)) and bpe._regular(tuple(ranks_of_file()))
    ids, decoded = bpe.Coder(ranks, P.PATTERN, float("inf")).round_trip([text])[0]
    assert ids == np.array(enc.encode_ordinary(text), np.int32).tobytes() and decoded == text.encode()


def test_null_keys_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    rows = bpe.encode_decode(docs, PATH, P.PATTERN).collect()
    assert [(r.doc_id, bytes(r.decoded)) for r in sorted(rows, key=lambda r: r.doc_id or 0)] == [(None, b"a b"), (None, b"a b"), (3, b"")]


def test_long_pieces_stay_in_memory_and_have_the_library_s_ids():


    ranks = [(base64.b64decode(line.split()[0]), int(line.split()[1])) for line in open(P.path("byte_bpe_50k.tiktoken"), "rb") if line.strip()]
    library = tiktoken.Encoding("long", pat_str=P.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})
    coder = bpe.Coder(ranks, P.PATTERN)
    rng = random.Random(3)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "ab" * 200_000, "-" * 300_000):
        ids, decoded = coder.round_trip([text])[0]
        assert decoded == text.encode() and np.frombuffer(ids, np.int32).tolist() == library.encode(text)
