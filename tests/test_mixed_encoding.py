"""Words that were read by a wrong code page, beside words that weren't."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T

WORDS = ["café", "naïve", "Größe", "señor", "l’été", "“quoted”", "10€", "Łódź", "привет", "日本", "Ünïcödé", "déjà"]


def run(spark, texts, **options):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.t for r in d.select("i", T.fix_mixed_encoding(F.col("t"), **options).alias("t")).orderBy("i").collect()]


@pytest.mark.parametrize("page", [p for p in T.CODE_PAGES if p not in ("cp1250", "cp1251")])
def test_words_of_every_page(spark, page):
    def misread(w):
        return "".join(bytes([b]).decode(page, "replace").replace("�", chr(b)) for b in w.encode())

    wrong = [misread(w) for w in WORDS]
    # a byte that is white space in a page can't be told from white space
    at = [i for i, w in enumerate(wrong) if not set(w) & set(" \t\r\n\x0b\f") and w != WORDS[i]]
    assert len(at) >= 9
    got = run(spark, [f"right é {wrong[i]}\n{WORDS[i]} plain  {wrong[i]}, über" for i in at], pages=(page,))
    assert got == [f"right é {WORDS[i]}\n{WORDS[i]} plain  {WORDS[i]}, über" for i in at]


def test_the_page_is_chosen(spark):
    texts = {p: "".join(bytes([b]).decode(p, "replace").replace("�", chr(b)) for b in "élève".encode()) for p in ("cp1252", "mac_roman", "cp437", "cp850")}
    assert run(spark, [f"ñ {t} ñ" for t in texts.values()]) == ["ñ élève ñ"] * len(texts)


def test_twice_over_and_mixed(spark):
    once = "é".encode().decode("latin-1")
    twice = once.encode().decode("latin-1")
    assert run(spark, [f"é {twice} {once}"]) == ["é é é"]
    assert run(spark, [f"é {twice}"], rounds=1) == [f"é {once}"]


def test_right_letters_are_left_alone(spark):
    right = ["Ça va, garçon? Où es-tu né? Ôtez", "Übergröße ß äöü ÄÖÜ", "«Ångström» Ãmã São Ãnh", "СССР — Россия, «Москва» № 5", "Ελληνικά κείμενα", "naïve café – déjà vu…", "Èôoi Èôô Ôô Êô ÍÔta", "日本語テキスト", "Łódź żółć", None, "", "plain", "é" * 5000, "x" * 100_000 + " é"]
    assert run(spark, right) == right


def test_stage_mends_lines_and_words(spark):
    d = spark.createDataFrame([(1, "é wrÃ©ng", 5)], "doc_id long, text string, n int")
    assert [tuple(r) for r in T.encoding_fixed(d).collect()] == [(1, "é wréng", 5)]


def test_letters_that_a_page_lacks_are_no_bytes(spark):
    # in mac_roman, Ð is no letter and would stand for a byte; a line separator isn't lost with a mended word
    word = "Ð∞"
    assert run(spark, [word], pages=("mac_roman",)) == [word]
    assert run(spark, ["Ã©\u2028"]) == ["Ã©\u2028"]


def test_only_odd_words_are_taken_out(spark):
    long = "x" * 20000
    assert run(spark, [f"Ã© {long} Ã¨\t{long}\nÃ©", f"{long}Ã© a", "  Ã©  "]) == [f"é {long} è\t{long}\né", f"{long}é a", "  é  "]
