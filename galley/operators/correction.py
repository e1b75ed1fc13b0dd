"""Repair of recognised texts as a chain of tables: lines, questions, distinct tokens, lines again."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import repair as R
from ..functions import spanish as S
from ..functions.text import once, upper_ratio
from .lineage import written


def split_lines(texts: DataFrame) -> DataFrame:
    """``texts(asset_id, text)`` -> ``asset_id, line, text``: trimmed lines; none of null and empty texts."""
    # no filter: it would be put below the text's own expression, which would be computed twice
    lines = F.posexplode(once(F.col("text"), lambda t: F.when(t != "", F.split(t, "\n")))).alias("line", "text")
    return texts.select("asset_id", lines).select("asset_id", "line", S.strip(F.col("text")).alias("text"))


def merge_question_lines(lines: DataFrame) -> DataFrame:
    """``lines(asset_id, line, text)`` -> ``asset_id, line, kind, text``: a question takes over the question and normal
    lines after it until one ends in ``?``; line is the first one's.

    Every line settles whether a question is open after it, except normal ones, which leave it as it was.
    """
    order = Window.partitionBy("asset_id").orderBy("line")
    stops, ends = F.col("kind").isin("BLANK", "TITLE", "ANSWER_OPTION"), F.col("text").endswith("?")
    settled = F.when(stops | ends, False).when(F.col("kind") == "QUESTION", True)
    rows = lines.withColumn("kind", R.line_kind(F.col("text"))).withColumn("open", F.coalesce(F.last(settled, True).over(order), F.lit(False)))
    joined = F.coalesce(F.lag("open").over(order), F.lit(False)) & ~stops
    rows = rows.withColumn("joined", joined).withColumn("head", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(order))
    first = F.min(F.struct("line", "kind")).alias("first")
    parts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("line", "text"))))
    merged = rows.groupBy("asset_id", "head").agg(first, F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
    return merged.select("asset_id", "first.line", "first.kind", "text")


def segment_tokens(tokens: DataFrame, dictionary: tuple[str, ...] = S.DICTIONARY) -> DataFrame:
    """``tokens(token, fixed)`` -> ``token, repaired``: ``fixed``, a long run of letters, as the fewest words of the
    dictionary, the first ones as short as they can be; as it is if it cannot be cut.  For distinct tokens.
    """
    words, longest = frozenset(dictionary), max(map(len, dictionary))

    def one(token: str) -> str:
        key, n = plain_key(token), len(token)
        best: list[tuple[int, int] | None] = [None] * n + [(0, n)]
        for start in range(n - 2, -1, -1):
            best[start] = min(((best[end][0] + 1, end) for end in range(start + 2, min(start + longest, n) + 1) if best[end] and key[start:end] in words), default=None)
        if len(key) != n or not best[0] or best[0][0] < 2:
            return token
        parts, at = [], 0
        while at < n:
            parts.append(token[at : best[at][1]])
            at = best[at][1]
        return " ".join(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"token": pdf["token"], "repaired": pdf["fixed"].map(one)})

    return tokens.select("token", "fixed").mapInPandas(run, "token string, repaired string")


def plain_key(token: str) -> str:
    """A token without marks, in small letters."""
    return "".join(c for c in unicodedata.normalize("NFD", token) if unicodedata.category(c) != "Mn").lower()


def suspects(text: Column) -> Column:
    """The distinct tokens of a text that ``token_repairs`` may change."""
    return F.filter(F.array_distinct(R.tokens(text)), lambda t: (F.length(t) > S.LONG_TOKEN) | S.may_be_broken(t))


def token_repairs(lines: DataFrame, dictionary: tuple[str, ...] = S.DICTIONARY) -> DataFrame:
    """``lines(suspects)`` -> ``token, repaired``: the distinct tokens that change."""
    valid = tuple(dict.fromkeys([*dictionary, *S.ACCENTS]))
    distinct = lines.select(F.explode("suspects").alias("token")).distinct()
    fixed = distinct.withColumn("fixed", S.fix_ocr_token(F.col("token"), valid))
    long = (F.length("fixed") > S.LONG_TOKEN) & F.col("fixed").rlike(r"^\p{L}+$") & ~S.word_key(F.col("fixed")).isin(*valid)
    short = fixed.where(~long).select("token", F.col("fixed").alias("repaired"))
    cut = segment_tokens(fixed.where(long), dictionary)
    return short.union(cut).where("token <> repaired")


def mend_tokens(lines: DataFrame, repairs: DataFrame) -> DataFrame:
    """``lines(asset_id, line, text, suspects, ...)`` with ``mended``: the text with its tokens repaired; a line is a key.

    Only the tokens that may change travel: joined by token, gathered per line, put back in one pass over the text.
    """
    each = lines.select("asset_id", "line", F.explode("suspects").alias("token")).join(repairs, "token")
    found = each.groupBy("asset_id", "line").agg(F.map_from_entries(F.collect_list(F.struct("token", "repaired"))).alias("changes"))
    joined = lines.join(found, ["asset_id", "line"], "left")
    mended = S.sub_tokens(F.col("text"), lambda t: F.coalesce(F.try_element_at("changes", t), t))
    return joined.withColumn("mended", F.when(F.col("changes").isNotNull(), mended).otherwise(F.col("text"))).drop("changes", "suspects")


def block_spacing(lines: DataFrame) -> DataFrame:
    """``lines(asset_id, line, kind, text)`` -> ``asset_id, text``: an empty line after titles, between a question and
    its options, and where there was one; none at the ends."""
    order = Window.partitionBy("asset_id").orderBy("line")
    rows = lines.withColumn("blanks", F.sum(F.when(F.col("kind") == "BLANK", 1).otherwise(0)).over(order)).where("kind <> 'BLANK'")
    before, gap = F.lag("kind").over(order), F.col("blanks") > F.lag("blanks").over(order)
    apart = gap | ((before == "TITLE") & (F.col("kind") != "TITLE")) | ((before == "QUESTION") & (F.col("kind") == "ANSWER_OPTION"))
    rows = rows.withColumn("lead", F.when(before.isNull(), "").when(apart, "\n\n").otherwise("\n"))
    parts = F.array_sort(F.collect_list(F.struct("line", F.concat("lead", "text").alias("text"))))
    return rows.groupBy("asset_id").agg(S.strip(F.array_join(F.transform(parts, lambda p: p["text"]), "")).alias("text"))


def corrected_lines(texts: DataFrame, dictionary: tuple[str, ...] = S.DICTIONARY) -> DataFrame:
    """``texts(asset_id, text)`` -> ``asset_id, line, kind, text``: the repaired lines before they are joined."""
    lines = merge_question_lines(split_lines(texts.select("asset_id", S.normalize_text(F.col("text")).alias("text"))))
    content = F.when(F.col("kind") == "ANSWER_OPTION", F.regexp_extract("text", S.OPTION, 2)).otherwise(F.col("text"))
    # read three times: for the tokens to repair, for their lines, and for the lines themselves
    lines = written(lines.withColumn("given", F.col("text")).withColumn("text", content).withColumn("suspects", suspects(F.col("text"))))
    mended = mend_tokens(lines, token_repairs(lines, dictionary))
    return mended.select("asset_id", "line", "kind", S.finish_line(F.col("kind"), F.col("given"), F.col("mended")).alias("text"))


def correct_text(texts: DataFrame, dictionary: tuple[str, ...] = S.DICTIONARY) -> DataFrame:
    """``texts(asset_id, text)`` -> ``asset_id, text``, a row per asset; null and empty texts become empty.

    asset_id is a key.  Other columns are not looked at.
    """
    done = block_spacing(corrected_lines(texts, dictionary)).withColumnRenamed("text", "corrected")
    return texts.select("asset_id").join(done, "asset_id", "left").select("asset_id", F.coalesce("corrected", F.lit("")).alias("text"))


def normalize_case(lines: DataFrame) -> DataFrame:
    """``lines(asset_id, line, text)`` with shouting and small lines in title or sentence case.

    A line goes on with a sentence if the one before it, neither empty nor an option, has no end: that is all a line
    needs to know of the others.
    """
    option = r"^\s*([A-Z])\)\s*(.+?)\s*$"
    order = Window.partitionBy("asset_id").orderBy("line")
    text, trimmed = F.col("text"), S.strip(F.col("text"))
    listed, blank = text.rlike(option), trimmed == ""
    unfinished = ~blank & ~listed & ~trimmed.rlike("[.?!:]$")
    rows = lines.withColumn("goes_on", F.coalesce(F.lag(unfinished).over(order), F.lit(False)))
    shouting, small = upper_ratio(text) >= 0.8, text == F.lower(text)
    title = ~trimmed.rlike("^[¿¡]") & ~trimmed.rlike("[.?!:;]$") & (F.size(F.split(trimmed, r"\s+")) <= 4) & ~F.col("goes_on")
    cased = F.when(F.col("goes_on"), S.sentence_case(text, False)).otherwise(S.sentence_case(text))
    done = (
        F.when(blank, "")
        .when(listed, F.concat(F.regexp_extract(text, option, 1), F.lit(") "), S.sentence_case(F.regexp_extract(text, option, 2))))
        .when(shouting, F.when(title, S.title_case(text)).otherwise(cased))
        .when(small, cased)
        .otherwise(text)
    )
    return rows.select("asset_id", "line", done.alias("text"))
