"""Text functions of the compliance engine, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and what they become without, in natural order.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"

# Spanish month and day names, and words that open a date range.
MONTHS = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|setiembre|septiembre|octubre|noviembre|diciembre"
DAYS = "lunes|martes|miércoles|miercoles|jueves|viernes|sábado|sabado|domingo"
SKU = r"(?iu)\bSKU\b[:\s#-]*([0-9]{5,12})\b"
PRICE = r"(?:S/\s*)?(\d{1,4}(?:[.,]\d{2}))\b"
DATE_WORDS = rf"(?iuU)\b(?:del|desde|hasta|al|sobre)\b|\b(?:{DAYS})\b|\b(?:{MONTHS})\b"
ROLE_DATE_WORDS = rf"(?iuU)\b(?:del|desde|hasta|al)\b|\b(?:{DAYS})\b|\b(?:{MONTHS})\b"
# Letters that all badges have, and with these all texts of other rules but by digits and capitals.
BADGE_HINTS = ("cmr", "déb", "deb", "exclu", "oportun", "falabella")
ROLE_HINTS = (*BADGE_HINTS, "sku", "precio")
# No digit, nor a letter that is one of ASCII where case does not count (ſ, K, ı, İ), and either no capital or two at most and a small
# letter, so that less than 3 in 4 letters are upper-case.
PLAIN_ROLE = r"(?s)^(?:[^\p{Lu}0-9ſı]*+|(?=.*?\p{Ll})(?:[^\p{Lu}0-9ſı]*+[\p{Lu}&&[^\x{212a}İ]]){1,2}[^\p{Lu}0-9ſı]*+)\z"
BADGE_WORDS = r"(?iuU)\b(?:cmr|d[ée]bito|exclusivo\s+con|oportunidad\s+única|oportunidad\s+unica|falabella)\b"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used; also keeps plans small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def compose(text: Column) -> Column:
    """Letters followed by a loose mark as one character, for the Latin letters of Spanish and its neighbours."""
    pairs = [(unicodedata.normalize("NFD", c), c) for c in MARKED]
    fixed = lambda text: reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)
    return once(text, lambda t: F.when(t.rlike(r"\p{Mn}"), fixed(t)).otherwise(t))


def strip_accents(text: Column) -> Column:
    """Letters without their marks; loose combining marks go too."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), r"\p{Mn}", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def norm_text(text: Column) -> Column:
    return F.lower(strip_accents(collapse(text)))


def norm_key(text: Column) -> Column:
    """A spreadsheet header as a key: no accents, upper case, blanks and hyphens as one underscore."""
    upper = F.upper(strip_accents(F.trim(F.coalesce(text, F.lit("")))))
    return F.regexp_replace(F.regexp_replace(upper, r"[\s\-]+", "_"), "[^A-Z0-9_]+", "")


def only_digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\D+", "")


def token_set(text: Column) -> Column:
    """Distinct tokens of two or more letters or digits."""
    return F.array_distinct(F.filter(F.split(norm_text(text), "[^a-z0-9]+"), lambda t: F.length(t) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if either set is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union.cast("double")).otherwise(F.lit(0.0))


def price_parse(text: Column) -> Column:
    """A price as double, the comma taken for a point; null if it is none."""
    value = F.replace(F.trim(text), F.lit(","), F.lit("."))
    return F.when(value.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), value.try_cast("double"))


def price_extract(text: Column) -> Column:
    """The last price-like number, with a decimal point; null without one."""
    found = F.regexp_extract_all(text, F.lit(PRICE), F.lit(1))
    return F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit("."))


def sku_extract(text: Column) -> Column:
    """The number after ``SKU``, else the digits of a text that is hardly more than them; null without either."""
    named, digits = F.regexp_extract(text, SKU, 1), only_digits(text)
    bare = (F.length(digits) >= 5) & (F.length(digits) <= 12) & (F.length(text) <= F.length(digits) + 2)
    return F.when(named != "", named).when(bare, digits)


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def date_hint(text: Column) -> Column:
    return text.rlike(DATE_WORDS) & has_digit(text)


def upper_ratio(text: Column) -> Column:
    """Share of upper-case among the letters; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    return F.when(letters > 0, upper / letters.cast("double")).otherwise(F.lit(0.0))


def looks_like_brand(text: Column) -> Column:
    t = collapse(text)
    tokens = F.split(t, " ")
    return (t != "") & (F.length(t) <= 28) & ~has_digit(t) & (F.size(tokens) <= 3) & (upper_ratio(t) >= 0.8) & F.forall(tokens, lambda w: F.length(w) >= 2)


def looks_like_campaign(text: Column) -> Column:
    t = collapse(text)
    return (t != "") & ~has_digit(t) & (F.size(F.split(t, " ")) <= 5) & (upper_ratio(t) >= 0.75)


def looks_like_description(text: Column) -> Column:
    t = collapse(text)
    return (F.length(t) >= 8) & ~t.rlike(SKU) & ~(t.rlike(PRICE) & (F.length(t) < 18))


def is_badge(text: Column) -> Column:
    """Whether a text has one of the badge words; letters that each of them has are looked for first, which is much cheaper."""
    return _holds(text, BADGE_HINTS) & text.rlike(BADGE_WORDS)


def _holds(text: Column, hints: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(h) for h in hints])


def text_role(text: Column) -> Column:
    """What a line of an advertising piece is, by the first rule that holds.

    Most texts cannot meet the rules but by their length.  Within a rule the cheap tests come first: a dear
    expression is only tried where the text can match.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    digit = has_digit(t)
    long = (F.length(t) >= 10) & (~t.rlike(r"\s\s") | (F.length(F.regexp_replace(t, r"\s+", " ")) >= 10))

    def by_shape(norm: Column) -> Column:
        words, capital = F.size(F.split(norm, " ")), norm.rlike(r"\p{Lu}")
        return (
            F.when(is_badge(t) & ~t.rlike(r"(?iu)\bprecio\b") & (F.length(norm) <= 60), "promo_badge")
            .when((F.length(norm) <= 18) & ~digit & capital & (words == 1) & (upper_ratio(norm) >= 0.86), "brand")
            .when((F.length(norm) <= 55) & ~digit & capital & (words <= 6) & (upper_ratio(norm) >= 0.75), "campaign")
            .when(F.length(norm) >= 10, "description")
            .otherwise("unknown")
        )

    return (
        F.when(~_holds(t, ROLE_HINTS) & t.rlike(PLAIN_ROLE), F.when(long, "description").otherwise("unknown"))
        .when(t == "", "unknown")
        .when(t.rlike("(?iu)sku") & t.rlike(r"(?iu)\bSKU\b"), "sku")
        .when(t.rlike(r"(?iu)precio\s+regular"), "price_secondary")
        .when(digit & ((t.contains("/") & t.rlike(r"(?iu)\bS\s*/")) | t.contains("S⁄") | t.contains("S\\/")) & t.rlike(PRICE), "price_main")
        .when(digit & (F.length(t) <= 12) & t.rlike(PRICE) & ~t.rlike(r"\p{L}"), "price_main")
        .when(digit & t.rlike(ROLE_DATE_WORDS), "date_range")
        .otherwise(once(F.regexp_replace(t, r"\s+", " "), by_shape))
    )


def ocr_score(average: Column, least: Column, length: Column, ratio: Column, digits: int = 4) -> Column:
    """Weighted quality of recognised text, 0 to 1 with so many digits; null without text."""
    raw = 0.55 * average + 0.20 * least + 0.15 * F.least(length / F.lit(120.0), F.lit(1.0)) + 0.10 * (F.lit(1.0) - ratio)
    return F.when(length > 0, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), digits))


def merge_page_text(a: Column, b: Column) -> Column:
    """Two readings of a page: the longer if they agree, the one that contains the other, else both on lines.

    Readings are compared without case and with white space collapsed.
    """
    a, b = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    x, y = F.lower(collapse(a)), F.lower(collapse(b))
    return (
        F.when(a == "", b)
        .when(b == "", a)
        .when(x == y, F.when(F.length(a) >= F.length(b), a).otherwise(b))
        .when(F.contains(y, x), b)
        .when(F.contains(x, y), a)
        .otherwise(F.concat_ws("\n", a, b))
    )


def hex_of_rgb(r: Column, g: Column, b: Column) -> Column:
    pair = lambda c: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("long")), 2, "0")
    return F.concat(F.lit("#"), pair(r), pair(g), pair(b))


def rgb_of_hex(text: Column) -> Column:
    """``#RRGGBB`` (the sign may lack) as an array of three ints; null if it is no colour."""
    t = F.upper(F.regexp_replace(F.trim(text), "^#", ""))
    part = lambda i: F.conv(F.substring(t, i, 2), 16, 10).cast("int")
    return F.when(t.rlike("^[0-9A-F]{6}$"), F.array(part(1), part(3), part(5)))
