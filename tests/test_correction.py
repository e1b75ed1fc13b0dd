import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from galley.functions import repair as R
from galley.functions import spanish as S
from galley.functions.text import norm_text
from galley.operators import correction as C
from galley.operators import dictionary

CASES = {
    "CUALES EL MARTILLOIDEAL\nPARA TRABAJOS DE CARPINTERIA\nEN CAOBA?": "¿Cuál es el martillo ideal para trabajos de carpintería en caoba?",
    "que tal ?": "¿Qué tal?",
    "Hola , mundo .": "Hola, mundo.",
    "A) MARTILLO DE BOLA\nB) SIERRA MANUAL": "A) MARTILLO DE BOLA\nB) SIERRA MANUAL",
    "UNA'": "UÑA",
    "TRIVIA PRO\nCUALES EL MARTILLOIDEAL\nPARA TRABAJOS DE CARPINTERIA\nEN CAOBA?\nA) MARTILLO DE BOLA\nB) MARTILLO DE GOMA\nC) MARTILLO DE CARPINTERO JAPONES\nD) MARTILLO DE CARPINTERO TIPO \"UNA'": (
        "TRIVIA PRO\n\n¿Cuál es el martillo ideal para trabajos de carpintería en caoba?\n\nA) MARTILLO DE BOLA\nB) MARTILLO DE GOMA\n"
        'C) MARTILLO DE CARPINTERO JAPONÉS\nD) MARTILLO DE CARPINTERO TIPO "UÑA"'
    ),
    "CUALES EL MARTILLOIDEAL": "¿Cuál es el martillo ideal?",
    "OFERTAS\n\n\n\nla página 5 Ã±andÃº": "OFERTAS\n\nla página 5 ñandú",
    "EL PRECIO DE LA SIERRA USB ES BAJO. LA TABLA NO": "El precio de la sierra USB es bajo. La tabla no",
    "el rnartillo y la pr0mocion": "el martillo y la promoción",
}


def test_known_texts(spark):
    rows = [*enumerate(CASES), (98, None), (99, "  \n ")]
    got = {r.asset_id: r.text for r in C.correct_text(spark.createDataFrame(rows, "asset_id long, text string")).collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())
    assert got[98] == got[99] == "" and len(got) == len(rows)


def fewest_words(token, words):
    """All ways to cut a token into words: the fewest, the first ones as short as can be."""
    key = "".join(c for c in unicodedata.normalize("NFD", token) if unicodedata.category(c) != "Mn").lower()

    def ways(start):
        if start == len(key):
            return [()]
        return [(end, *rest) for end in range(start + 2, len(key) + 1) if key[start:end] in words for rest in ways(end)]

    found = sorted(ways(0), key=lambda w: (len(w), w))
    if not found or len(found[0]) < 2:
        return token
    return " ".join(token[a:b] for a, b in zip((0, *found[0][:-1]), found[0], strict=True))


def test_segmentation_against_all_cuts(spark):
    rng = random.Random(1)
    tokens = ["".join(rng.choices(["martillo", "MADERA", "de", "la", "Línea", "xq", "para"], k=rng.randrange(2, 5))) for _ in range(80)] + ["", "x" * 5000, "lalala" * 2]
    frame = spark.createDataFrame([(t, t) for t in tokens], "token string, fixed string")
    got = [r.repaired for r in C.segment_tokens(frame).collect()]
    assert got == [fewest_words(t, set(S.DICTIONARY)) if len(t) < 200 else t for t in tokens]


@pytest.mark.parametrize(("lines", "want"), [
    (["que es", "esto", "", "fin"], [("QUESTION", "que es esto"), ("BLANK", ""), ("NORMAL_TEXT", "fin")]),
    (["como va?", "bien gracias"], [("QUESTION", "como va?"), ("NORMAL_TEXT", "bien gracias")]),
    (["que tal", "A) uno", "nada"], [("QUESTION", "que tal"), ("ANSWER_OPTION", "A) uno"), ("NORMAL_TEXT", "nada")]),
    (["uno", "donde esta", "la casa?", "y ahora"], [("NORMAL_TEXT", "uno"), ("QUESTION", "donde esta la casa?"), ("NORMAL_TEXT", "y ahora")]),
])
def test_questions_take_over_lines(spark, lines, want):
    rows = C.merge_question_lines(spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "asset_id long, line int, text string")).orderBy("line").collect()
    assert [(r.kind, r.text) for r in rows] == want


def test_single_steps(spark):
    def one(f, text):
        return spark.createDataFrame([(text,)], "t string").select(f(S.F.col("t"))).first()[0]

    assert one(S.question_marks, '? dime "algo".') == '¿dime "algo".?' and one(S.question_marks, "¿ya?") == "¿ya?"
    assert one(S.balance_quotes, 'el "uno.') == 'el "uno".'
    assert one(S.sentence_case, "HOLA. QUE PASA ¿tu USB? ça VA") == "Hola. Que pasa ¿Tu USB? ça Va"
    assert one(lambda c: S.restore_accents(c, True), "COMO Mas que") == "CÓMO Más qué"
    assert one(S.normalize_text, "“a” ,b\r\n\n\n\n c !d") == '"a", b\n\nc! d'
    assert re.fullmatch("uña", one(S.fix_ocr_token, "un'a"))


def test_question_grammar_ends_words_as_the_twin_does(spark):
    lines = ["que esíñ arga", "Cual laá casa", "cuales lasñ", "cual el fin", "cual la_ casa", "que es", "cual\u00a0el fin"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in lines], "t string").select(S.repair_question_grammar(F.col("t")).alias("t")).collect()]
    assert got == ["Qué esíñ arga", "Cuál es laá casa", "Cuáles son lasñ", "Cuál es el fin", "cual la_ casa", "Qué es", "cual\u00a0el fin"]


def test_common_subsequences_of_a_batch_are_those_of_one_key():
    draw = random.Random(3)
    keys = ["", "Ñ", "MAESTRO", "M\0A", *("".join(draw.choice("ABCÑ\U0001f600") for _ in range(draw.randint(0, 90))) for _ in range(200))]
    for term in ("", "A", "ABC", "SAN ISIDRO", "CBAÑ" * 16):
        assert dictionary.common_subsequences(keys, term).tolist() == [dictionary.common_subsequence(k, term) for k in keys]


def odd_lines(n: int, seed: int) -> list[str]:
    """Lines of pieces that the quick ways of the repair must treat as the long ones do."""
    draw = random.Random(seed)
    parts = ["que", "Qué", "QU'E", "tv", "LED", "Ñandú", "è", "Été", "más", "MAS", "numero", "a", "x1", "_", ".", "?", "!", "¿", "¡", ",", ";", " ", " ", "  ", "\t", "\n", "\r\n", " ", " ", '"', "“", "Ã¡", "é", "'", "ß", "K", "İ", "", "日本"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(n)]


def test_quick_ways_give_what_the_long_ones_give(spark):
    df = spark.createDataFrame([(t,) for t in odd_lines(4000, 5)], "text string")
    c = F.col("text")
    tidy = df.select(c, S._tidied(c).alias("long"), S.normalize_text(c).alias("quick")).where("not (long <=> quick)").collect()
    assert tidy == []
    asks = df.select(c, R.more_than_four(c).alias("quick"), (F.size(R.tokens(c)) > 4).alias("long")).where("quick <> long").collect()
    assert asks == []
    may = df.where(norm_text(c).rlike(R.ASKING) & ~F.col("text").rlike(R.MAY_ASK)).collect()
    assert may == []
    plain = lambda t: F.when(t.rlike("(?s).*"), S.sub_tokens(t, lambda w: F.coalesce(F.when(S.word_key(w).isin(*S.ACCENTS), F.lit("#")), w)))
    changed = df.select(c, S.restore_accents(c).alias("quick"), plain(c).alias("long"))
    assert changed.where("(long <> text) and quick = text and not (lower(text) rlike 'más|manual|imagen|qué')").collect() == []
    # a word more than any abbreviation's sends a text the long way
    again = df.where(~c.contains("\u2028")).select(c, S.sentence_case(c).alias("quick"), S.sentence_case(F.concat(c, F.lit(" tv"))).alias("long"))
    assert again.where("concat(quick, ' TV') <> long and concat(quick, ' TV') <> replace(long, 'Tv', 'TV')").collect() == []
