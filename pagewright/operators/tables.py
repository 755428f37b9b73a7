"""Table structure: cells to dividers, characters to cells, table blocks.

Cells: table_cells(doc_id, pnum, box_idx, cell_idx, label, score, x0..y1) relative to their box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..functions import text as T
from .page import PAGE, XY, _as

TABLE = [*PAGE, "box_idx"]
CELL = "struct<x0:double,y0:double,x1:double,y1:double,score:double>"


def dedupe_cells(cells: Column, axis: int, share: float = 0.3) -> Column:
    """A sorted array of cells without near copies: a cell that covers at least `share` of the last kept one replaces it if
    it scores higher, and else goes. The scan is in order, as each step depends on what was kept."""

    def overlap(a: Column, b: Column) -> Column:
        return G.intersection_pct(tuple(a[c] for c in XY), tuple(b[c] for c in XY))

    def step(kept: Column, c: Column) -> Column:
        last = F.element_at(kept, -1)
        better = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(c))
        return F.when(F.size(kept) == 0, F.array(c)).when(overlap(last, c) < share, F.concat(kept, F.array(c))).when(c["score"] > last["score"], better).otherwise(kept)

    return F.aggregate(cells, F.array().cast(f"array<{CELL}>"), step)


def close_gaps(cells: Column, axis: int) -> Column:
    """Neighbouring cells share the middle of the gap between them."""
    lo, hi = ("x0", "x1") if axis == 0 else ("y0", "y1")
    n = F.size(cells)

    def one(c: Column, i: Column) -> Column:
        before = F.when(i > 0, (F.get(cells, i - 1)[hi] + c[lo]) / 2).otherwise(c[lo])
        after = F.when(i < n - 1, (c[hi] + F.get(cells, i + 1)[lo]) / 2).otherwise(c[hi])
        return c.withField(lo, before).withField(hi, after)

    return F.transform(cells, one)


def dividers(cells: DataFrame, boxes: DataFrame, score: float = 0.5) -> DataFrame:
    """doc_id, pnum, box_idx, row_dividers, col_dividers of tables that have rows and columns: the begins of their cells and
    the end of the last, in units of the page's image. Tables without aren't tables."""
    good = cells.filter(F.col("score") > score)
    some = {}
    for name, label, axis in (("rows", "table row", 1), ("cols", "table column", 0)):
        lead = "x0" if axis == 0 else "y0"
        of = good.filter(F.col("label") == label)
        # equal begins keep the order of the cells
        array = F.sort_array(F.collect_list(F.struct(F.col(lead).alias("lead"), "cell_idx", F.struct(*XY, "score").alias("c"))))
        kept = of.groupBy(*TABLE).agg(F.transform(array, lambda x: x["c"]).alias("c")).select(*TABLE, dedupe_cells(F.col("c"), axis).alias("c"))
        # a column of its own, as each cell looks at its neighbours
        some[name] = kept.select(*TABLE, close_gaps(F.col("c"), axis).alias(name))
    both = some["rows"].join(some["cols"], TABLE).join(boxes.select(*TABLE, F.col("x0").alias("ox"), F.col("y0").alias("oy")), TABLE)
    rows = F.concat(F.transform("rows", lambda c: c["y0"] + F.col("oy")), F.array(F.element_at("rows", -1)["y1"] + F.col("oy")))
    cols = F.concat(F.transform("cols", lambda c: c["x0"] + F.col("ox")), F.array(F.element_at("cols", -1)["x1"] + F.col("ox")))
    return both.select(*TABLE, rows.alias("row_dividers"), cols.alias("col_dividers"))


def slot(ends: Column, at: Column) -> Column:
    """The first interval between neighbours that holds a value, ends included; null outside."""
    n = F.size(ends)
    inside = F.filter(F.sequence(F.lit(0), n - 2), lambda i: (F.get(ends, i) <= at) & (at <= F.get(ends, i + 1)))
    return F.when(n > 1, F.get(inside, 0))


def cell_texts(pieces: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, pnum, box_idx, rows (array<array<string>>): the texts of pieces (text, box in image units, order columns
    o1..on) whose centres lie in a cell, in order; every cell of the grid is there."""
    order = [c for c in pieces.columns if c.startswith("o_")]
    # most pieces of a page are in none of its tables, which the outermost dividers tell
    y, x = (F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2
    outer = [f("row_dividers").alias(f"{n}_y") for n, f in (("lo", F.array_min), ("hi", F.array_max))] + [f("col_dividers").alias(f"{n}_x") for n, f in (("lo", F.array_min), ("hi", F.array_max))]
    within = pieces.join(tables.select("*", *outer), PAGE).filter(y.between(F.col("lo_y"), F.col("hi_y")) & x.between(F.col("lo_x"), F.col("hi_x")))
    hit = within.withColumn("r", slot(F.col("row_dividers"), y)).withColumn("c", slot(F.col("col_dividers"), x))
    hit = hit.filter("r is not null and c is not null")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), "")
    filled = hit.groupBy(*TABLE, "r", "c").agg(text.alias("text")).groupBy(*TABLE).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("r", "c"), "text"))).alias("m"))
    grid = tables.join(filled, TABLE, "left")
    n, k = F.size("row_dividers") - 1, F.size("col_dividers") - 1
    # no Python name may be shared by the nested functions' variables
    cell = lambda r: F.transform(F.sequence(F.lit(0), k - 1), lambda c: F.coalesce(F.try_element_at(F.col("m"), F.struct(r.alias("r"), c.alias("c"))), F.lit("")))
    return grid.select(*TABLE, F.transform(F.sequence(F.lit(0), n - 1), cell).alias("rows"))


def table_blocks(blocks: DataFrame, boxes: DataFrame, texts: DataFrame, share: float = 0.7) -> DataFrame:
    """Blocks of a page with table blocks in place of what the table boxes cover: (doc_id, pnum, place, block_no, box_idx,
    text, table_data). A table stands where the first block that it covers stood; tables without text or blocks don't."""
    b = _as(boxes.filter("label = 'Table'"), "box_idx")
    hit = blocks.filter("block_type = 'Table'").join(b, PAGE).filter(G.intersects(G.box(), G.box("b"))).filter(G.intersection_pct(G.box(), G.box("b")) > share)
    first = hit.groupBy(*TABLE).agg(F.min("block_no").alias("block_no"))
    filled = first.join(texts.filter(F.size("rows") > 0), TABLE).withColumn("text", T.github_table(F.col("rows"))).withColumn("table_data", T.csv_dump(F.col("rows")))
    rest = blocks.join(hit.select(*PAGE, "block_no").distinct(), [*PAGE, "block_no"], "left_anti")
    null = F.lit(None)
    every = rest.select(*PAGE, "block_no", null.cast("int").alias("box_idx"), null.cast("string").alias("text"), null.cast("string").alias("table_data")).unionByName(filled.select(*PAGE, "block_no", "box_idx", "text", "table_data"))
    return every.withColumn("place", F.row_number().over(W.partitionBy(*PAGE).orderBy("block_no", F.col("box_idx").asc_nulls_last())) - 1)


def fit_to_bounds(boxes: DataFrame, tables: DataFrame) -> DataFrame:
    """Table boxes clamped to their dividers; table boxes without dividers are text."""
    j = boxes.join(tables, TABLE, "left")
    has = F.col("row_dividers").isNotNull()
    lo = {"x": F.element_at("col_dividers", 1), "y": F.element_at("row_dividers", 1)}
    hi = {"x": F.element_at("col_dividers", -1), "y": F.element_at("row_dividers", -1)}
    clamp = {c: F.when(has, F.greatest(F.least(F.col(c), hi[c[0]]), lo[c[0]])).otherwise(F.col(c)) for c in XY}
    return j.withColumns(clamp).withColumn("label", F.when((F.col("label") == "Table") & ~has, "Text").otherwise(F.col("label")))
