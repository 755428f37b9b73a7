import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import document as D
from pagewright.operators import ocr
from pagewright.operators import page as P
from pagewright.operators import tables as TB
from pagewright.plans import synthetic as S


def blocks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, pnum int, block_no int, x0 double, y0 double, x1 double, y1 double")


def test_labels_first_box_wins_ties_and_fallback(spark):
    b = blocks(spark, [(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, 500.0, 500.0, 510.0, 510.0), (1, 1, 0, 0.0, 0.0, 1.0, 1.0)])
    boxes = spark.createDataFrame([(1, 0, 3, "Late", 0.0, 0.0, 10.0, 10.0), (1, 0, 2, "Early", 0.0, 0.0, 10.0, 10.0), (1, 0, 1, "First", 90.0, 0.0, 91.0, 1.0)], "doc_id long, pnum int, box_idx int, label string, x0 double, y0 double, x1 double, y1 double")
    got = {(r.pnum, r.block_no): r.block_type for r in P.annotate_blocks(b, boxes).collect()}
    assert got == {(0, 0): "Early", (0, 1): "First", (1, 0): "Text"}


def lines(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, pnum int, block_no int, sub_no int, line_no int, block_type string, text string, image_name string, table_data string, x0 double, y0 double, y1 double")


def test_merge_lines_images_come_before_the_block_around_them(spark):
    rows = [(1, 0, 0, 0, 0, "Text", "It be", None, None, 0.0, 0.0, 9.0), (1, 0, 0, 1, 1, "Image", "![i](i)", "i", None, 0.0, 0.0, 9.0), (1, 0, 0, 2, 2, "Text", "gins.", None, None, 5.0, 9.0, 19.0), (1, 1, 0, 0, 0, "Title", "end", None, None, 0.0, 0.0, 5.0)]
    got = [(r.block_type, r.text) for r in D.merge_lines(lines(spark, rows)).orderBy("index").collect()]
    assert got == [("Image", "![i](i)"), ("Text", "It be gins."), ("Title", "# End\n")]
    got = [r.block_type for r in D.merge_lines(lines(spark, rows), flush_at_images=True).orderBy("index").collect()]
    assert got == ["Text", "Image", "Text", "Title"]


def test_merge_lines_tables_of_one_width(spark):
    rows = [(1, 0, i, 0, 0, "Table", f"t{i}", None, d, 0.0, 0.0, 1.0) for i, d in enumerate(["a,b", "c,d", "e,f,g"])]
    got = [(r.text, r.table_data) for r in D.merge_lines(lines(spark, rows)).orderBy("index").collect()]
    assert got == [("\nt0\nt1\n", "a,b\nc,d"), ("\nt2\n", "e,f,g")]


def test_dividers_and_cells(spark):
    cells = [(1, 0, 0, i, "table row", 0.9, 0.0, y, 30.0, y + 9) for i, y in enumerate((0.0, 10.0, 10.5))] + [(1, 0, 0, 9, "table column", 0.9, 0.0, 0.0, 30.0, 20.0), (1, 0, 0, 8, "table row", 0.5, 0.0, 50.0, 1.0, 60.0)]
    c = spark.createDataFrame(cells, "doc_id long, pnum int, box_idx int, cell_idx int, label string, score double, x0 double, y0 double, x1 double, y1 double")
    box = spark.createDataFrame([(1, 0, 0, "Table", 100.0, 200.0, 130.0, 220.0)], "doc_id long, pnum int, box_idx int, label string, x0 double, y0 double, x1 double, y1 double")
    d = TB.dividers(c, box)
    r = d.first()
    assert r.row_dividers == [200.0, 209.5, 219.0] and r.col_dividers == [100.0, 130.0]
    pieces = spark.createDataFrame([(1, 0, "b", 100.0, 209.0, 102.0, 210.0, 2), (1, 0, "a", 100.0, 201.0, 102.0, 203.0, 1), (1, 0, "out", 300.0, 201.0, 302.0, 203.0, 3)], "doc_id long, pnum int, text string, x0 double, y0 double, x1 double, y1 double, o_1 int")
    assert TB.cell_texts(pieces, d).first().rows == [["ab"], [""]]  # an end belongs to the earlier cell


def test_watermark_thresholds(spark):
    rows = [(1, 0, 0, i, 0, "X") for i in range(9)] + [(1, 0, 1, 0, 0, "y")]
    s = spark.createDataFrame(rows, "doc_id long, pnum int, block_no int, line_no int, span_no int, text string")
    assert [r.mark for r in P.watermark_texts(s, 8).collect()] == ["X"]
    assert P.watermark_texts(s, 9).count() == 0
    assert P.watermark_texts(s.filter("block_no = 0"), 2).count() == 0  # too few spans
    assert [r.text for r in P.remove_watermarks(s, 0.5).collect()] == ["y"]  # over half of two texts


def test_split_headings_and_reading_order(spark, data):
    s = S.spans(spark, data)
    b = S.blocks(s)
    boxes = P.to_page(S.layout_boxes(b), S.IMAGE_BOX, S.PAGE_BOX).withColumn("position", F.col("box_idx"))
    placed = P.reading_order(b, boxes)
    assert placed.count() == b.count() == placed.select("doc_id", "pnum", "place").distinct().count()
    once = P.align_spans(s)
    assert P.align_spans(once.select(s.columns)).count() == once.count()


def test_no_nested_loops(spark, data):
    """Overlap joins are by page."""
    s = S.spans(spark, data)
    b = S.blocks(s)
    boxes = P.to_page(S.layout_boxes(b), S.IMAGE_BOX, S.PAGE_BOX)
    for df in (P.annotate_blocks(b, boxes), P.image_spans(boxes, S.lines(s), b), D.line_coverage(S.lines(s).withColumnRenamed("line_no", "line_idx"), S.lines(s))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pushdown(spark, data):
    plan = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id > 5").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan


def test_languages(spark):
    d = spark.createDataFrame([("german",), ("en",), (None,), ("klingon",)], "lang string")
    assert {r.lang: r.code for r in ocr.language_codes(d, strict=False).collect()} == {"german": "de", "en": "en", None: None, "klingon": None}
    try:
        ocr.language_codes(d).collect()
        raise AssertionError("an unknown language has to raise")
    except Exception as e:
        assert "no language code" in str(e)


def test_common_titles(spark):
    rows = [(1, i, "Title", f"# Annual report {i}") for i in range(5)] + [(1, 9, "Title", "Alone"), (1, 10, "Text", "Annual report")]
    d = spark.createDataFrame(rows, "doc_id long, index int, block_type string, text string")
    assert sorted(r["index"] for r in D.common_titles(d).collect()) == [0, 1, 2, 3, 4]
    near = d.withColumn("text", F.when(F.col("index") == 2, "Annual reports").otherwise(F.col("text")))
    assert sorted(r["index"] for r in D.common_titles(near).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r["index"] for r in D.common_titles(near, exact=True).collect()) == [0, 1, 3, 4]


def test_merge_lines_joins_as_one_text_would(spark):
    """Against a fold over the whole text."""
    import random

    from pagewright.functions import text as T

    r = random.Random(4)
    parts = ["word", "end.", "hyph-", "  ", "", "a,", "Next", " lead", "trail ", ",", "x", "日本", "9"]
    rows, want = [], {}
    for doc in range(60):
        texts = [r.choice(parts) for _ in range(r.randint(1, 9))]
        rows += [(doc, 0, 0, 0, i, "Caption", t, None, None, float(r.randint(0, 1)), 0.0, 1.0) for i, t in enumerate(texts)]
    got = {x.doc_id: x.text for x in D.merge_lines(lines(spark, rows)).collect()}
    for doc in {x[0] for x in rows}:
        mine = [x for x in rows if x[0] == doc]
        goes_on = [i > 0 and a[9] == b[9] for i, (a, b) in enumerate(zip(mine, [mine[0], *mine]))]
        want[doc] = [(x[6], c) for x, c in zip(mine, goes_on)]
    steps = spark.createDataFrame([(d, w) for d, w in want.items()], "doc_id long, items array<struct<t:string,c:boolean>>")
    fold = F.aggregate("items", F.lit(""), lambda a, x: F.when(a == "", x["t"]).otherwise(T.join_lines(a, x["t"], F.lit("Caption"), x["c"])))
    assert got == {x.doc_id: x.r for x in steps.select("doc_id", fold.alias("r")).collect()}


@pytest.mark.parametrize("similar", [60.0, 90.0, 100.0])
def test_similar_titles_by_all_pairs(spark, similar):
    r = random.Random(int(similar))
    base = ["Annual report", "Contents", "Appendix of tables and figures", "A"]
    rows = []
    for doc in range(3):
        for i in range(60):
            t = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                t.insert(r.randrange(len(t) + 1), r.choice("xyzab"))
            rows.append((doc, i, "Title", "".join(t)))
    keys = {(d, i): k for d, i, k in spark.createDataFrame(rows, "doc_id long, index int, block_type string, text string").select("doc_id", "index", D.title_key(F.col("text"))).collect()}
    want = set()
    for (d, i), t in keys.items():
        mine = [k for (e, _), k in keys.items() if e == d]
        others = sum(D.indel_ratio(t, k) >= similar for k in mine) - 1
        if others >= max(3.0, len(mine) * 0.05):
            want.add((d, i))
    got = D.common_titles(spark.createDataFrame(rows, "doc_id long, index int, block_type string, text string"), similar).collect()
    assert {(x.doc_id, x["index"]) for x in got} == want and 0 < len(want) < len(rows)


def test_cells_are_scanned_once(spark):
    """Closing gaps looks at neighbours, which must not repeat the scan for each of them."""
    cells = spark.createDataFrame([(1, 0, 0, i, x, 0.9, 0.0, 0.0, 9.0, 9.0) for i, x in enumerate(["table row", "table column"])], "doc_id long, pnum int, box_idx int, cell_idx int, label string, score double, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([(1, 0, 0, 5.0, 7.0)], "doc_id long, pnum int, box_idx int, x0 double, y0 double")
    d = TB.dividers(cells, boxes)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2
    assert [tuple(r) for r in d.select("row_dividers", "col_dividers").collect()] == [([7.0, 16.0], [5.0, 14.0])]
