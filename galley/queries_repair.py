"""The queries of the repair of recognised texts, with DuckDB twins where RE2 and SQL can say a step."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import repair as R
from .functions import spanish as S
from .operators import correction
from .queries import query
from .sources.fixtures import fixture

TOKEN = "[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9'']+"
WORD = "[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]+"


def _again(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return _again(x, r"^\s+|\s+$", "")


def _normal(x: str) -> str:
    """``normalize_text`` for DuckDB: the characters that a look-ahead would see are taken and put back."""
    for broken, fixed in R.MOJIBAKE:
        x = f"replace({x}, '{broken}', '{fixed}')"
    x = f"translate({_again(f'nfc_normalize({x})', chr(92) + 'r' + chr(92) + 'n?', chr(10))}, {_quote(S.QUOTES)}, {_quote(S.PLAIN_QUOTES)})"
    for pattern, to in (
        (r"[ \t]+", " "),
        (r"\s+([,.;:!?])", r"\1"),
        (r"([¿¡])\s+", r"\1"),
        (r"([,.;:])([^\s.,;:!?])", r"\1 \2"),
        (r"([!?])([^\s!?.,;:\"])", r"\1 \2"),
        (r" *\n *", "\n"),
        (r"\n{3,}", "\n\n"),
    ):
        x = _again(x, pattern, to)
    return _strip(x)


def _spaced(x: str) -> str:
    between = (r'([\p{L}\p{N}_)])"([\p{L}\p{N}_])', r'\1 "\2')
    return _again(_again(_again(_normal(x), r'"\s+([,.;:?!])', r'"\1'), *between), *between)


def _key(x: str) -> str:
    return f"trim(lower(replace(strip_accents({x}), '''', '')))"


def _balanced(x: str) -> str:
    return f"CASE WHEN (length({x}) - length(replace({x}, '\"', ''))) % 2 = 1 THEN regexp_replace({x}, '[?!.,;:]+$', '') || '\"' || regexp_extract({x}, '([?!.,;:]+)$', 1) ELSE {x} END"


KIND = rf"""CASE WHEN t = '' THEN 'BLANK' WHEN regexp_matches(t, '^\s*[A-Z]\)\s*.+?\s*$') THEN 'ANSWER_OPTION'
  WHEN contains(t, '?') OR contains(t, '¿') OR regexp_matches(lower(strip_accents(t)), '\b(que|cual|cuales|como|donde|cuando|por\s+que|quien|quienes)\b') THEN 'QUESTION'
  WHEN len(ws) <= 4 AND CASE WHEN nl > 0 THEN nu / CAST(nl AS DOUBLE) ELSE 0.0 END >= 0.75 AND NOT regexp_matches(t, '[?!.,;:]$') AND lower(strip_accents(coalesce(ws[1], ''))) NOT IN ({', '.join(map(_quote, R.NO_TITLE))}) THEN 'TITLE' ELSE 'NORMAL_TEXT' END"""
#: Lines of the raw texts, of the normalised ones with their kinds, and these with questions joined.
RAW_LINES = ", ls AS (SELECT asset_id, unnest(range(len(l))) AS line, " + _strip("unnest(l)") + " AS t FROM (SELECT asset_id, string_split(text, chr(10)) AS l FROM fx_raw_text WHERE text <> ''))"
KINDS = (
    f", ls AS MATERIALIZED (SELECT asset_id, unnest(range(len(l))) AS line, {_strip('unnest(l)')} AS t FROM (SELECT asset_id, string_split(text, chr(10)) AS l FROM (SELECT asset_id, {_normal('text')} AS text FROM fx_raw_text) WHERE text <> '')),"
    rf" w AS (SELECT *, regexp_extract_all(t, '{TOKEN}') AS ws, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS nl, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS nu FROM ls), kinds AS MATERIALIZED (SELECT asset_id, line, t, {KIND} AS kind FROM w)"
)
MERGED = (
    KINDS
    + """, settled AS (SELECT *, kind IN ('BLANK', 'TITLE', 'ANSWER_OPTION') AS stops, CASE WHEN kind IN ('BLANK', 'TITLE', 'ANSWER_OPTION') OR ends_with(t, '?') THEN false WHEN kind = 'QUESTION' THEN true END AS s FROM kinds),
    opened AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AND NOT stops AS joined FROM settled),
    heads AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id ORDER BY line) AS head FROM opened),
    merged AS MATERIALIZED (SELECT asset_id, min(line) AS line, arg_min(kind, line) AS kind, coalesce(string_agg(t, ' ' ORDER BY line) FILTER (WHERE t <> ''), '') AS text FROM heads GROUP BY asset_id, head)"""
)


def _raw(spark, d):
    return fixture(spark, d, "fx_raw_text")


def _lines(spark, d):
    return correction.split_lines(_raw(spark, d))


def _merged(spark, d):
    return correction.merge_question_lines(correction.split_lines(_raw(spark, d).select("asset_id", S.normalize_text(F.col("text")).alias("text"))))


@query(f"SELECT asset_id, {_normal('text')} AS text FROM fx_raw_text", "fx_raw_text")
def normalize_text(spark, d):
    return _raw(spark, d).select("asset_id", S.normalize_text(F.col("text")).alias("text"))


@query(MERGED + " SELECT asset_id, CAST(line AS INT) AS line, kind, text FROM merged", "fx_raw_text")
def merge_question_lines(spark, d):
    return _merged(spark, d)


@query()
def fix_ocr_tokens(spark, d):
    """Distinct tokens that the repair of characters changes."""
    tokens = _lines(spark, d).select(F.explode(F.array_distinct(R.tokens(F.col("text")))).alias("token")).distinct()
    return tokens.withColumn("fixed", S.fix_ocr_token(F.col("token"))).where("token <> fixed")


@query()
def segment_tokens(spark, d):
    tokens = _lines(spark, d).select(F.explode(F.array_distinct(R.tokens(F.col("text")))).alias("token")).distinct()
    return correction.segment_tokens(tokens.where(F.length("token") > S.LONG_TOKEN).withColumn("fixed", F.col("token"))).where("token <> repaired")


@query(
    RAW_LINES
    + rf""", p AS (SELECT asset_id, line, regexp_split_to_array(t, '{TOKEN}') AS gaps, regexp_extract_all(t, '{TOKEN}') AS ws FROM ls),
    fixes AS (SELECT MAP {{{', '.join(f"{_quote(k)}: {_quote(v)}" for k, v in S.ACCENTS.items())}}} AS m),
    distinct_words AS (SELECT DISTINCT unnest(ws) AS w FROM p),
    done AS (SELECT w, CASE WHEN r IS NULL THEN w WHEN upper(w) = w AND lower(w) <> w THEN upper(r) WHEN lower(w) = w AND upper(w) <> w THEN r
      WHEN regexp_matches(w, '^[^\p{{L}}]*\p{{Lu}}\p{{Ll}}*([^\p{{L}}]+\p{{Lu}}\p{{Ll}}*)*[^\p{{L}}]*$') THEN upper(r[1]) || r[2:] ELSE r END AS v FROM (SELECT w, m[{_key('w')}] AS r FROM distinct_words, fixes)),
    each AS (SELECT asset_id, line, unnest(range(1, len(gaps) + 1)) AS i, unnest(gaps) AS gap, unnest(list_append(ws, NULL)) AS w FROM p)
    SELECT asset_id, CAST(line AS INT) AS line, string_agg(gap || coalesce(v, ''), '' ORDER BY i) AS text FROM each LEFT JOIN done USING (w) GROUP BY 1, 2""",
    "fx_raw_text",
)
def restore_accents(spark, d):
    return _lines(spark, d).select("asset_id", "line", S.restore_accents(F.col("text")).alias("text"))


@query(
    RAW_LINES
    + rf""", p AS (SELECT asset_id, line, regexp_split_to_array(t, '[\p{{L}}\p{{N}}_]+') AS gaps, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+') AS ws FROM ls),
    each AS (SELECT *, regexp_full_match(coalesce(w, ''), '{WORD}') AS tok, regexp_matches(gap, '[¿¡]|[.!?]\s*$') AS trig FROM (SELECT asset_id, line, unnest(range(1, len(gaps) + 1)) AS i, unnest(gaps) AS gap, unnest(list_append(ws, NULL)) AS w FROM p)),
    seen AS (SELECT *, max(CASE WHEN tok THEN i END) OVER (PARTITION BY asset_id, line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS word_at, max(CASE WHEN trig THEN i END) OVER (PARTITION BY asset_id, line ORDER BY i) AS stop_at FROM each),
    low AS (SELECT *, CASE WHEN NOT tok THEN coalesce(w, '') WHEN upper(w) IN ({', '.join(map(_quote, S.ACRONYMS))}) THEN upper(w) ELSE lower(w) END AS v, tok AND (word_at IS NULL OR stop_at > word_at) AS cap FROM seen)
    SELECT asset_id, CAST(line AS INT) AS line, string_agg(gap || CASE WHEN cap THEN upper(v[1]) || v[2:] ELSE v END, '' ORDER BY i) AS text FROM low GROUP BY 1, 2""",
    "fx_raw_text",
)
def sentence_case(spark, d):
    return _lines(spark, d).select("asset_id", "line", S.sentence_case(F.col("text")).alias("text"))


@query(
    MERGED
    + rf""", o AS (SELECT *, CASE WHEN text[:1] = '¿' THEN text ELSE '¿' || regexp_replace(text, '^\?*\s*', '') END AS a FROM merged WHERE kind = 'QUESTION'),
    e AS (SELECT *, regexp_extract(a, '([.!,:;"]+)$', 1) AS last FROM o)
    SELECT asset_id, CAST(line AS INT) AS line, CASE WHEN ends_with(a, '?') THEN a ELSE a || '?' END AS text FROM e""",
    "fx_raw_text",
)
def question_marks(spark, d):
    return _merged(spark, d).where("kind = 'QUESTION'").select("asset_id", "line", S.question_marks(F.col("text")).alias("text"))


GRAMMAR = _again("regexp_replace(regexp_replace(text, '(?i)^(¿?\\s*)cu[aá]l(?:es)?\\s+(el|la|un|una)\\b', '\\1Cuál es \\2'), '(?i)^(¿?\\s*)cu[aá]l(?:es)?\\s+(los|las|unos|unas)\\b', '\\1Cuáles son \\2')", "(?i)^(¿?\\s*)qu[eé]\\s+es\\b", "\\1Qué es")


@query(MERGED + f" SELECT asset_id, CAST(line AS INT) AS line, {GRAMMAR} AS text FROM merged WHERE kind = 'QUESTION'", "fx_raw_text")
def repair_question_grammar(spark, d):
    return _merged(spark, d).where("kind = 'QUESTION'").select("asset_id", "line", S.repair_question_grammar(F.col("text")).alias("text"))


@query(RAW_LINES + f" SELECT asset_id, CAST(line AS INT) AS line, {_balanced('t')} AS text FROM ls", "fx_raw_text")
def balance_quotes(spark, d):
    return _lines(spark, d).select("asset_id", "line", S.balance_quotes(F.col("text")).alias("text"))


@query(RAW_LINES + f" SELECT asset_id, CAST(line AS INT) AS line, {_spaced('t')} AS text FROM ls", "fx_raw_text")
def output_spacing(spark, d):
    return _lines(spark, d).select("asset_id", "line", S.output_spacing(F.col("text")).alias("text"))


@query(
    MERGED
    + rf""", b AS (SELECT *, sum(CAST(kind = 'BLANK' AS INT)) OVER (PARTITION BY asset_id ORDER BY line) AS blanks FROM merged),
    l AS (SELECT *, lag(kind) OVER o AS before, lag(blanks) OVER o AS blanks_before FROM b WHERE kind <> 'BLANK' WINDOW o AS (PARTITION BY asset_id ORDER BY line)),
    s AS (SELECT *, CASE WHEN before IS NULL THEN '' WHEN blanks > blanks_before OR (before = 'TITLE' AND kind <> 'TITLE') OR (before = 'QUESTION' AND kind = 'ANSWER_OPTION') THEN chr(10) || chr(10) ELSE chr(10) END AS lead FROM l)
    SELECT asset_id, {_strip("string_agg(lead || text, '' ORDER BY line)")} AS text FROM s GROUP BY 1""",
    "fx_raw_text",
)
def block_spacing(spark, d):
    return correction.block_spacing(_merged(spark, d))


@query()
def correct_text(spark, d):
    return correction.correct_text(_raw(spark, d))
