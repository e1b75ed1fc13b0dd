"""Repair and rating of recognised Spanish text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compose, norm_text, once, strip_accents, upper_ratio

# Doubly encoded letters and what they stand for.
MOJIBAKE = (("Ã¡", "á"), ("Ã©", "é"), ("Ã­", "í"), ("Ã³", "ó"), ("Ãº", "ú"), ("Ã¼", "ü"), ("Ã±", "ñ"), ("Â¿", "¿"), ("Â¡", "¡"))
# Words that begin no title.
NO_TITLE = ("a", "al", "con", "de", "del", "el", "en", "la", "las", "los", "o", "para", "por", "sin", "u", "un", "una", "y")
TOKEN = r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9']+"
LETTER = r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]"
ASKING = r"(?i)\b(que|cual|cuales|como|donde|cuando|por\s+que|quien|quienes)\b"

#: Matches every text with a word of ASKING, whatever marks its letters have: q and u, or c or d with what may follow.
MAY_ASK = r"(?i)q\p{Mn}*[^a-tv-z\s]|c\p{Mn}*[^a-np-tv-z\s]\p{Mn}*[^b-ln-z\s]|d\p{Mn}*[^a-np-z\s]\p{Mn}*[^a-mo-z\s]\p{Mn}*d"


def fix_mojibake(text: Column) -> Column:
    """Doubly encoded letters mended, letters with loose marks composed; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for broken, fixed in MOJIBAKE:
        out = F.replace(out, F.lit(broken), F.lit(fixed))
    return compose(out)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def more_than_four(text: Column) -> Column:
    """Whether a text has more than four tokens: only its beginning is read."""
    return text.rlike(rf"^(?:{TOKEN.replace('[', '[^').replace('+', '*+')}{TOKEN}+){{5}}")


def line_kind(text: Column) -> Column:
    """BLANK, ANSWER_OPTION, QUESTION, TITLE or NORMAL_TEXT."""
    words = tokens(text)
    first = F.lower(strip_accents(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))))
    title = ~more_than_four(text) & (upper_ratio(text) >= 0.75) & ~text.rlike(r"[?!.,;:]$") & ~first.isin(*NO_TITLE)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "BLANK")
        .when(text.rlike(r"^\s*[A-Z]\)\s*.+?\s*$"), "ANSWER_OPTION")
        .when(text.contains("?") | text.contains("¿") | (text.rlike(MAY_ASK) & norm_text(text).rlike(ASKING)), "QUESTION")
        .when(title, "TITLE")
        .otherwise("NORMAL_TEXT")
    )


def correction_ratio(raw: Column, corrected: Column) -> Column:
    """Share of places whose tokens differ without case; 0 if neither text has a letter."""
    a, b = F.transform(tokens(raw), F.lower), F.transform(tokens(corrected), F.lower)
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit("")) == F.coalesce(y, F.lit("")))
    changed = F.size(F.filter(same, lambda s: ~s))
    worded = F.coalesce(raw, F.lit("")).rlike(LETTER) | F.coalesce(corrected, F.lit("")).rlike(LETTER)
    return F.when(worded, changed / F.greatest(F.size(same), F.lit(1)).cast("double")).otherwise(F.lit(0.0))


def variant_score(text: Column) -> Column:
    """(letters and digits, words with a letter), by which readings of one piece are ranked."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w.rlike(r"\p{L}"))
    return F.struct(F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")).alias("characters"), F.size(words).alias("words"))


def present_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """Terms that stand in a text as whole words, without case, in the order given; a word's ends are only looked at
    where its letters stand."""
    whole = lambda upper, t: F.contains(upper, F.lit(t.upper())) & upper.rlike(rf"(?U)(?<!\w)\Q{t.upper()}\E(?!\w)")
    found = lambda upper: F.array_compact(F.array(*[F.when(whole(upper, t), F.lit(t)) for t in terms]))
    return once(F.upper(F.coalesce(text, F.lit(""))), found)


def split_hex_list(text: Column) -> Column:
    """Colours ``#RRGGBB`` of a list parted by commas or blanks: in upper case, valid ones only, each once, in order."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), r"[,\s]+"), lambda t: F.concat(F.lit("#"), F.upper(F.regexp_replace(F.trim(t), "^#", ""))))
    return F.array_distinct(F.filter(items, lambda t: t.rlike("^#[0-9A-F]{6}$")))
