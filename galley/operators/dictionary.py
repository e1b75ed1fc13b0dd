"""Correction of tokens by small dictionaries of brands, places and words of advertising, and the entities of a text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.repair import present_terms
from ..functions.spanish import is_lower, is_upper, sub_tokens
from ..functions.text import collapse, strip_accents

# Brands, places and words of advertising.
BRANDS = ("SODIMAC", "MAESTRO", "CONSTRUCTOR")
CITIES = ("LIMA", "AREQUIPA", "TRUJILLO", "CHICLAYO", "PIURA", "ICA", "CUSCO", "HUANCAYO", "CALLAO")
DISTRICTS = ("MIRAFLORES", "SAN ISIDRO", "SURCO", "LA MOLINA", "SAN BORJA", "CHACARILLA")
MARKETING = ("ANIVERSARIO", "SEMANA", "OFERTAS", "DESCUENTOS", "PROMOCIÓN", "CELEBREMOS", "JUNTOS")
DICTIONARIES = (BRANDS, (*CITIES, *DISTRICTS), MARKETING)
THRESHOLD = 85
WORD = r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]+(?:['-][A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]+)*"


def fuzzy_key(token: Column) -> Column:
    """A token in capitals without marks, with letters for the digits that recognition takes for them."""
    return F.translate(strip_accents(F.upper(token)), "015", "OIS")


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def common_subsequences(keys: list[str], term: str) -> np.ndarray:
    """``common_subsequence`` of each key and one term of at most 64 characters, a bit a character: all keys take one
    character at a time, so the work is that of the longest key, whatever the term's length."""
    place = {c: i for i, c in enumerate(dict.fromkeys(term), 1)}
    masks = np.zeros(len(place) + 1, np.uint64)
    for i, c in enumerate(term):
        masks[place[c]] |= np.uint64(1 << i)
    table = np.zeros(max(map(ord, term), default=0) + 2, np.intp)
    for c, i in place.items():
        table[ord(c)] = i
    codes = np.array(keys, dtype=f"<U{max(1, max(map(len, keys), default=1))}").view(np.uint32).reshape(len(keys), -1)
    at = table[np.minimum(codes, len(table) - 1)]
    row = np.full(len(keys), 2**64 - 1, np.uint64)
    for j in range(at.shape[1]):
        same = row & masks[at[:, j]]
        row = (row + same) | (row - same)
    return np.bitwise_count(~row & np.uint64((1 << len(term)) - 1)).astype(np.int64)


def fuzzy_dictionary(tokens: DataFrame, dictionaries: tuple[tuple[str, ...], ...] = DICTIONARIES, threshold: float = THRESHOLD) -> DataFrame:
    """``tokens(token)`` -> ``token, term, score`` of the tokens that a term resembles, for distinct tokens.

    The score is 200 x common subsequence / both lengths.  The best term of a dictionary is its first of the greatest
    score, an earlier dictionary wins ties.  Tokens without a letter resemble nothing, and lengths too far apart are not
    compared.  The dictionaries are constants of the job, so their size is bounded.
    """
    terms = [[(k, t) for k, t in ((_plain(t), t) for t in d)] for d in dictionaries]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, lengths = pdf["key"].to_numpy(object), pdf["key"].str.len().to_numpy(np.int64)
            best, score = np.full(len(pdf), None, object), np.zeros(len(pdf))
            for k, term in chain.from_iterable(terms):
                whole = lengths + len(k)
                near = np.flatnonzero(200.0 * np.minimum(lengths, len(k)) >= threshold * whole)
                if not len(near):
                    continue
                common = common_subsequences(keys[near].tolist(), k) if len(k) <= 64 else np.array([common_subsequence(key, k) for key in keys[near]])
                s = 200.0 * common / whole[near]
                better = (s >= threshold) & (s > score[near])
                best[near[better]], score[near[better]] = term, s[better]
            found = np.flatnonzero(score > 0)
            yield pd.DataFrame({"token": pdf["token"].to_numpy(object)[found], "term": best[found], "score": score[found]})

    keyed = tokens.where(F.col("token").rlike(r"\p{L}")).select("token", fuzzy_key(F.col("token")).alias("key"))
    return keyed.mapInPandas(run, "token string, term string, score double")


def _plain(term: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFD", term.upper()) if unicodedata.category(c) != "Mn")
    return bare.translate(str.maketrans("015", "OIS"))


def _cased(source: Column, term: Column) -> Column:
    title = source.rlike(r"^[^\p{L}]*\p{Lu}\p{Ll}*(?:[^\p{L}]+\p{Lu}\p{Ll}*)*[^\p{L}]*$")
    return F.when(is_upper(source), F.upper(term)).when(is_lower(source), F.lower(term)).when(title, F.initcap(term)).otherwise(term)


def entity_text(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``texts(asset_id, text)`` -> ``asset_id, text, brands, locations``: tokens corrected, blanks collapsed, and the terms
    that stand in the result.  Only tokens that change travel back to their texts; asset_id is a key."""
    tokens = texts.select("asset_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))).alias("token"))
    fixed = fuzzy_dictionary(tokens.select("token").distinct(), threshold=threshold).select("token", _cased(F.col("token"), F.col("term")).alias("to")).where("to <> token")
    changes = tokens.join(fixed, "token").groupBy("asset_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "to"))).alias("changes"))
    joined = texts.select("asset_id", F.coalesce("text", F.lit("")).alias("text")).join(changes, "asset_id", "left")
    changed = sub_tokens(F.col("text"), lambda t: F.coalesce(F.try_element_at("changes", t), t), WORD)
    done = joined.select("asset_id", collapse(F.when(F.col("changes").isNotNull(), changed).otherwise(F.col("text"))).alias("text"))
    return done.select("asset_id", "text", present_terms(F.col("text"), BRANDS).alias("brands"), present_terms(F.col("text"), (*CITIES, *DISTRICTS)).alias("locations"))
