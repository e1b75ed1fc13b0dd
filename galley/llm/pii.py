"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Strict patterns find seed entities in whole texts.  The two words to the left of an entity are a lexical pattern, and so
are the word to its left with the word to its right.  Patterns and the number-like or address-like instances that they precede, over all documents, form a graph on which
scores go back and forth: a pattern is as good as the share of its instances that are known, an instance as good as its
best pattern.  Patterns of high confidence then name the kind of instances that no strict pattern covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound, cut

KINDS = ("email", "ip", "card", "phone")
#: The strict patterns.  Possessive quantifiers and the look-behinds change no match: an entity can only begin where a
#: run of its characters begins or the last match has ended.  They keep long runs linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text with a match must pass.
HINTS = {"email": "@", "phone": "+", "ip": ".", "card": ""}
#: What may be an identifier that no strict pattern covers: digits with separators, or a masked address.
#: An address starts where its run of characters does, else every character of a long run would be a start.
LOOSE = r"(?:(?<![A-Za-z0-9@+])[0-9](?:[\x20().-]{0,2}[0-9]){6,18}|(?:(?<![A-Za-z0-9._%+@-])|\G)[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++)(?![A-Za-z0-9@])"
#: Characters of context kept on either side of an instance; known instances that a pattern needs; confidence it needs; rounds.
CONTEXT, SUPPORT, CONFIDENCE, ROUNDS = 60, 4, 0.8, 3

_OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"


def occurrences(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start,end,value,left,right>>``; positions in code points.

    ``split`` has the texts between the matches, so running sums of lengths give the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def with_context(parts: Column) -> Column:
        n = F.size(parts) - 1
        sides = F.zip_with(F.slice(parts, F.lit(1), n), F.slice(parts, F.lit(2), n), lambda a, b: F.struct(F.length(a).alias("gap"), F.right(a, F.lit(CONTEXT)).alias("left"), F.left(b, F.lit(CONTEXT)).alias("right")))
        return F.zip_with(sides, found, lambda s, m: F.struct(s["gap"].alias("gap"), m.alias("value"), s["left"].alias("left"), s["right"].alias("right")))

    empty = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["pos"] + p["gap"]
        end = start + F.length(p["value"])
        one = F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"), p["left"].alias("left"), p["right"].alias("right"))
        return F.struct(end.alias("pos"), F.array_append(acc["out"], one).alias("out"))

    pairs = bound(F.split(text, pattern, -1), with_context)
    return F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {"email": F.lit(True), "ip": value.rlike(_OCTETS), "card": F.when((n >= 12) & (n <= 19), luhn(_digits(value))).otherwise(False), "phone": (n >= 9) & (n <= 15)}[kind]


def contexts(o: Column) -> Column:
    """The lexical patterns that an occurrence stands in, in lower case; none where there are too few words."""
    two = F.regexp_extract(F.lower(o["left"]), r"(\S+\s+\S+\s*)$", 1)
    before, after = F.regexp_extract(F.lower(o["left"]), r"(\S+)\s*$", 1), F.regexp_extract(F.lower(o["right"]), r"^\s*(\S+)", 1)
    left = F.when(two != "", F.concat(F.regexp_replace(F.trim(two), r"\s+", " "), F.lit(" _")))
    around = F.when((before != "") & (after != ""), F.concat(before, F.lit(" _ "), after))
    return F.array_compact(F.array(left, around))


def base_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, base, loose``: strict entities and further candidates of every text, without the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kind_type = "array<struct<start:int,end:int,kind:int,value:string,left:string,right:string>>"

    def entities(number: int, kind: str) -> Column:
        got = F.filter(occurrences(text, PATTERNS[kind]), lambda o: valid(kind, o["value"]))
        tagged = F.transform(got, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"), F.lit(number).alias("kind"), o["value"].alias("value"), o["left"].alias("left"), o["right"].alias("right")))
        return F.when(F.contains(text, F.lit(HINTS[kind])), tagged).otherwise(F.array().cast(kind_type))

    parts = [entities(number, kind) for number, kind in enumerate(KINDS)]
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("digest"), F.concat(*parts).alias("base"), occurrences(text, LOOSE).alias("loose"))
    apart = F.filter("loose", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    return rows.withColumn("loose", apart)


def confident_patterns(found: DataFrame) -> DataFrame:
    """``(context, kind, score)`` of the patterns that the graph of all documents bears out."""
    seeds = found.select(F.explode("base").alias("o"))
    others = found.select(F.explode("loose").alias("o"))
    each = lambda rows: rows.select(F.explode(contexts(F.col("o"))).alias("context"), F.lower("o.value").alias("instance"))
    edges = cut(each(seeds).union(each(others)).distinct())
    seeds = seeds.select(F.lower("o.value").alias("instance"), F.col("o.kind").alias("kind"))
    known = cut(seeds.select("instance", "kind").distinct().withColumn("score", F.lit(1.0)))
    totals = edges.groupBy("context").agg(F.count("*").alias("total"))
    scores = known
    good = None
    for _ in range(ROUNDS):
        mass = edges.join(scores, "instance").groupBy("context", "kind").agg(F.sum("score").alias("mass"))
        good = cut(mass.join(totals, "context").select("context", "kind", (F.col("mass") / F.col("total")).alias("score"), "mass").where((F.col("mass") >= SUPPORT) & (F.col("score") >= CONFIDENCE)).drop("mass"))
        reached = edges.join(good, "context").groupBy("instance", "kind").agg(F.max("score").alias("score"))
        scores = cut(known.union(reached).groupBy("instance", "kind").agg(F.max("score").alias("score")))
    return good


def find(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, base, discovered, spans``, a row per document.

    All three are arrays of ``struct<start,end,kind>`` (code points, end exclusive; kind is a place in KINDS), by start
    and kind.  Base spans always stay; discovered ones overlap none of them.  Null counts as empty; repeated rows each
    get their row but count once as evidence; an empty table gives an empty result.
    """
    found = cut(base_spans(docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))))
    patterns = confident_patterns(found)
    loose = found.where("size(loose) > 0").select("doc_id", "digest", F.explode("loose").alias("o"))
    named = loose.withColumn("context", F.explode(contexts(F.col("o")))).join(patterns, "context")
    best = named.groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("dig"), "o").agg(F.min_by("kind", F.struct(-F.col("score"), "kind")).alias("kind"))
    per_doc = best.groupBy("id", "dig").agg(F.array_sort(F.collect_set(F.struct(F.col("o.start").alias("start"), F.col("o.end").alias("end"), "kind"))).alias("discovered"))
    joined = found.join(per_doc, F.col("digest").eqNullSafe(F.col("dig")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    bare = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind")))
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    out = joined.select("doc_id", bare.alias("base"), F.coalesce("discovered", none).alias("discovered"))
    order = lambda spans: F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    return out.select("doc_id", order(F.col("base")).alias("base"), "discovered", order(F.concat("base", "discovered")).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
