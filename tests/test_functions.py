"""Small cases worked out by hand."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright import models
from pagewright.functions import chunking as C
from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.operators.document import indel_ratio


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()) or "x int"
    return spark.createDataFrame([tuple(row.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "a, b, kind, goes_on, want",
    [
        ("exam-", "ple", "Text", False, "example"),
        ("A", "Title", "Title", False, "A Title"),
        ("x = 1", "y = 2", "Formula", False, "x = 1\ny = 2"),
        ("some words,", "And more", "Text", False, "some words, And more"),
        ("The End", "Next", "Text", True, "The End Next"),
        ("It ends.", "Next", "Text", False, "It ends.\n\nNext"),
        ("a,b", "c,d", "Table", False, "a,b\n\nc,d"),
        ("X", "Y", "Code", False, "X\nY"),
        ("", "b", "Text", False, "\nb"),
    ],
)
def test_join_lines(spark, a, b, kind, goes_on, want):
    assert one(spark, T.join_lines(*[F.col(c) for c in "abkc"]), a=a, b=b, k=kind, c=goes_on) == want


@pytest.mark.parametrize("s", ["it's a-b c3d 3RD", "ßach über", "", "ÉTÉ", "a b\nc"])
def test_title_case(spark, s):
    assert one(spark, T.title_case(F.col("s")), s=s) == s.title()


def test_text_edges(spark):
    assert one(spark, T.strip(F.col("s")), s=" \t a \n") == "a"
    assert one(spark, T.cleanup_text(F.col("s")), s="a\n\n\n\nb c") == "a\n\nb c"
    assert one(spark, T.replace_bullets(F.col("s")), s="• a\n● b x• c") == "- a\n- b x• c"
    assert one(spark, T.surround_text(F.col("s"), "*"), s="  ") == "  **  "
    assert one(spark, T.replace_dots(F.col("s")), s="a . . . b ..... c") == "a . . . b c"
    assert one(spark, T.bad_ocr(F.col("s")), s="") is True
    assert one(spark, T.bad_ocr(F.col("s")), s="�" * 7 + "x" * 90) is True
    assert one(spark, T.bad_ocr(F.col("s")), s="�" * 6 + "x" * 90) is False
    assert one(spark, T.alphanum_ratio(F.col("s")), s=" \n") == 1.0
    assert one(spark, T.font_flags(F.col("n")), n=(1 << 6) | 1) == "fixed_pitch_italic"
    assert one(spark, T.span_text(F.col("s")), s="a-\nb\r\n\n") == "ab"
    assert one(spark, T.block_surround(F.col("s"), F.lit("Code")), s="x") == "\n```\nx\n```\n"
    assert one(spark, T.base64_text(F.col("s").cast("binary")), s="x" * 200).count("\n") == 0
    assert one(spark, T.strip(F.col("s")), s=None) is None


def test_chunks(spark):
    assert one(spark, C.fixed_chunks(F.col("s"), 2), s="a b\nc") == ["a b", "c"]
    assert one(spark, C.sliding_chunks(F.col("s"), 2, 1), s="a b c") == ["a b", "b c", "c"]
    assert one(spark, C.fixed_chunks(F.col("s"), 2), s="  ") == []
    assert one(spark, C.regex_chunks(F.col("s")), s="a\n\n\n\nb") == ["a", "", "b"]
    assert one(spark, C.sentence_chunks(F.col("s")), s="One. Two! One. ") == ["One.", "Two!"]
    with pytest.raises(ValueError):
        C.chunk(spark.range(1), "none")


def test_tiles():
    a, b = "alpha beta gamma delta " * 60, "uno dos tres cuatro " * 60
    text = a + "\n\n" + b
    assert "".join(C.tile(text)) == text
    assert len(C.tile(text)) == 2
    assert C.tile(None) == [] and C.tile("few words") == ["few words"]


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_indel_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    want = 100.0 if not a and not b else 200.0 * table[-1][-1] / (len(a) + len(b))
    assert indel_ratio(a, b) == pytest.approx(want)


def test_boxes(spark):
    def pct(a, b):
        return one(spark, G.intersection_pct(G.literal(*a), G.literal(*b)))

    assert pct((0, 0, 2, 2), (1, 1, 3, 3)) == 0.25
    assert pct((0, 0, 2, 2), (2, 0, 3, 3)) == 0.0
    assert pct((0, 0, 0, 2), (0, 0, 3, 3)) == 0.0
    assert one(spark, G.half_even(F.lit(2.5))) == 2.0
    assert [one(spark, c) for c in G.rescale_int(G.literal(-2.7, 1, 2, 3), (F.lit(1.0), F.lit(1.0)), (F.lit(1.0), F.lit(1.0)))][0] == -2
    assert [one(spark, c) for c in G.polygon_box(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((5.0, 9.0), (1.0, 9.0), (1.0, 2.0), (5.0, 2.0))]))] == [1.0, 2.0, 5.0, 9.0]


def test_fix_encoding(spark):
    good = ["café", "naïve — “quoted” €5", "日本語", "plain", "", None, "Ä Ö Ü ß", "a\nhéé\nb"]
    wrong = [g and g.encode().decode("latin-1") for g in good] + ["naÃ¯ve â€” â‚¬5", "cafÃ© and é", "cafÃ©\né"]
    want = good + ["naïve — €5", "cafÃ© and é", "café\né"]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(wrong, good + [None] * 3))], "i int, a string, b string")
    rows = df.select("i", T.fix_encoding(F.col("a")).alias("a"), T.fix_encoding(F.col("b")).alias("b")).orderBy("i").collect()
    assert [r.a for r in rows] == want
    assert [r.b for r in rows][: len(good)] == good
    assert models.run("fix_encoding", df.select(F.col("a").alias("text"))).count() == len(wrong)
