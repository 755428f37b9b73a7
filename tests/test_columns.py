"""Reading order of pages with columns, against orders marked by hand."""

import pytest

from pagewright import models
from pagewright.operators import columns

SCHEMA = "doc_id long, pnum int, block_no int, x0 double, y0 double, x1 double, y1 double"

#: Boxes (x0, y0, x1, y1) in the order in which a reader takes them.
PAGES = {
    "one column": [(50, 50, 550, 100), (50, 110, 550, 300), (50, 310, 550, 500)],
    "two columns": [(50, 50, 290, 200), (50, 203, 290, 400), (50, 404, 290, 700), (310, 50, 550, 120), (310, 123, 550, 500), (310, 505, 550, 700)],
    "heading and two columns": [(50, 30, 550, 60), (50, 80, 290, 300), (50, 304, 290, 700), (310, 80, 550, 400), (310, 403, 550, 700)],
    "heading, columns, wide picture, columns": [(50, 30, 550, 60), (50, 80, 290, 200), (310, 80, 550, 200), (50, 220, 550, 400), (50, 420, 290, 700), (310, 420, 550, 700)],
    "three columns": [(50, 50, 200, 300), (50, 303, 200, 700), (220, 50, 370, 250), (220, 253, 370, 700), (390, 50, 540, 350), (390, 355, 540, 700)],
    "three columns below two": [(50, 50, 290, 200), (310, 50, 550, 200), (50, 230, 200, 500), (220, 230, 370, 400), (220, 404, 370, 500), (390, 230, 540, 500)],
    "a column beside rows": [(50, 50, 200, 700), (230, 50, 550, 200), (230, 215, 380, 400), (400, 215, 550, 400), (230, 420, 550, 700)],
    "overlapping lines": [(50, 50, 550, 72), (50, 70, 550, 92), (50, 90, 550, 112)],
    "footnotes below columns": [(50, 50, 290, 600), (310, 50, 550, 610), (50, 640, 550, 700)],
}


@pytest.fixture(scope="module")
def placed(spark):
    rows = []
    for doc, (name, boxes) in enumerate(PAGES.items()):
        for page in range(2):
            # the block numbers say nothing: they run backwards
            rows += [(doc, page, len(boxes) - i, *map(float, b)) for i, b in enumerate(boxes)]
    got = columns.reading_order(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    return {(r.doc_id, r.pnum, r.block_no): r.place for r in got}


@pytest.mark.parametrize("name", PAGES)
def test_hand_marked_orders(placed, name):
    doc = list(PAGES).index(name)
    n = len(PAGES[name])
    for page in range(2):
        assert [placed[doc, page, n - i] for i in range(n)] == list(range(n))


def test_layout_and_order_are_built_in(spark):
    boxes = spark.createDataFrame([(1, 0, i, *map(float, b)) for i, b in enumerate(PAGES["heading and two columns"])], SCHEMA)
    got = sorted(models.run("layout_detection", boxes).collect(), key=lambda r: r.box_idx)
    assert [(r.x0, r.y0, r.x1, r.y1) for r in got] == [(50, 30, 550, 60), (50, 80, 290, 700), (310, 80, 550, 700)]
    assert [(r.box_idx, r.position) for r in models.run("reading_order", boxes).orderBy("box_idx").collect()] == [(0, 0), (1, 1), (2, 2)]


def test_odd_boxes(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, None, None, None, None), (1, 0, 2, 0.0, 50.0, 10.0, 60.0), (1, 0, 2, 0.0, 50.0, 10.0, 60.0), (None, None, 5, 1.0, 1.0, 0.0, 0.0)]
    got = columns.reading_order(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id or 0, r.block_no, r.place) for r in got)) == [(0, 5, 0), (1, 0, 0), (1, 1, 3), (1, 2, 1), (1, 2, 2)]
    assert columns.reading_order(spark.createDataFrame([], SCHEMA)).collect() == []


def test_plan(spark):
    plan = columns.reading_order(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "NestedLoop" not in plan
