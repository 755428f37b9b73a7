"""Which pages need recognition is found out in one pass over the pages, and by the detected lines once."""

import __spark_entry__
from pagewright.operators import document as D

BOX = "doc_id long, pnum int, line_idx int, x0 double, y0 double, x1 double, y1 double"


def test_lines_that_nothing_covers_count(spark):
    detected = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, 0.0, 20.0, 10.0, 30.0), (2, 0, 0, 0.0, 0.0, 10.0, 10.0), (None, 0, 0, 0.0, 0.0, 10.0, 10.0)], BOX)
    lines = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 4.0, 10.0), (1, 0, 1, 5.0, 0.0, 9.0, 10.0), (1, 0, 2, 0.0, 20.0, 5.0, 30.0), (None, 0, 0, 0.0, 0.0, 10.0, 10.0)], BOX)
    got = {r.doc_id: (r.found, r.total, r.covered) for r in D.line_coverage(detected, lines).collect()}
    assert got == {1: (1, 2, True), 2: (0, 1, False), None: (0, 1, False)}


def test_needed_keeps_columns(spark):
    pages = spark.createDataFrame([(1, 0, "words that are right"), (1, 1, " "), (2, 0, " "), (2, 1, ""), (3, 0, "%" * 50), (4, 0, "words again"), (None, 0, " ")], "doc_id long, pnum int, text string")
    cover = spark.createDataFrame([(1, 0, 3, True), (1, 1, 3, True), (2, 0, 2, True), (3, 0, 1, True), (4, 0, 5, False), (None, 0, 1, False)], "doc_id long, pnum int, total int, covered boolean")
    needed = D.ocr_needed(pages, cover, keep=("text",))
    got = {(r.doc_id, r.pnum): (r.text, r.needed) for r in needed.collect()}
    assert got == {(1, 0): ("words that are right", False), (1, 1): (" ", True), (2, 0): (" ", True), (2, 1): ("", False), (3, 0): ("%" * 50, True), (4, 0): ("words again", True)}
    # by three tables, and by one
    new = pages.selectExpr("doc_id", "pnum", "'new words here' as text")
    joined = D.ocr_replace(pages.filter("doc_id is not null"), needed.drop("text"), new)
    assert sorted(joined.collect()) == sorted(D.ocr_replaced(needed.selectExpr("*", "'new words here' as new")).collect())


def test_pages_are_made_three_times_at_most(spark):
    for name in ("ocr_stats", "ocr_needed"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") <= 3
